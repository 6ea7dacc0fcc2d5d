"""MinHash near-duplicates: chosen-path set similarity join.

Every document's set of word shingles is summarised by independent minwise
values.  The roots of independent trees are single coordinates: a document goes
to the node named by its value there.  A node with few documents is compared
exhaustively (signatures first, then the full sets); a larger one branches every
document again by ``branching`` further coordinates chosen by a hash of the node,
level by level, until its nodes are small.  Documents that merely share a
frequent passage part at the next coordinate, so no hot node is ever paired.

Recall: a pair of similarity s meets in one root with probability s and in one
child with 1 - (1 - s)^branching.  With 20 roots and 2 branches a pair at 0.75 is
missed with probability 0.25^20 = 9e-13 in small root nodes, and with
(1 - 0.75 * 0.9375^d)^20 below hot ones: 4e-9 at depth d = 3, 7e-6 at ``MAX_DEPTH``.

Links are confirmed on the full sets, 100 * intersection >= 75 * union.  Copies
(equal shingle sets) are one vertex; inside a node only a spanning set of
confirmed links leaves the task, so groups of near copies never become pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.shingles import (jaccard_counts, mix64, permutation_constants, shingle_set,
                                signature)
from quire.session import bound_batches, materialize, trim_memory

N_COORDS = 64
N_ROOTS = 20
BRANCHING = 2
LEAF = 256
BLOCK = 1024
EXHAUST = 4096
MAX_DEPTH = 8
CENTRES = 8
SEED = 1009

#: Arrow batches of groups hold their members' signatures or texts: so many groups at a time.
GROUPS_PER_BATCH = 200

_SIGNED = ("doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, sig binary, "
           "roots array<bigint>")


def _node_keys(parent: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    h = mix64(parent.view(np.uint64) + np.uint64(0x632BE59BD9B4E019) * (coord.astype(np.uint64)
                                                                       + np.uint64(1)))
    return mix64(h ^ value.astype(np.uint64)).view(np.int64)


def _sign(batches):
    mul, add = permutation_constants(N_COORDS, SEED)
    zero = np.zeros(N_ROOTS, dtype=np.int64)
    coords = np.arange(N_ROOTS)
    for batch in batches:
        out = {k: [] for k in ("n", "fp1", "fp2", "sig", "roots")}
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            sig = signature(s, mul, add)
            out["n"].append(len(s))
            out["fp1"].append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
            out["fp2"].append(int(np.add.reduce(mix64(~s)).view(np.int64)) if len(s) else 0)
            out["sig"].append(sig.tobytes() if len(s) else None)
            out["roots"].append(_node_keys(zero, coords, sig[:N_ROOTS]) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out["n"], pa.int64()),
             pa.array(out["fp1"], pa.int64()), pa.array(out["fp2"], pa.int64()),
             pa.array(out["sig"], pa.binary()), pa.array(out["roots"], pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "sig", "roots"])
    trim_memory()


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, N_COORDS)


def _branch(batches):
    """(node, v, sig, part) of large nodes -> (child node, v, part), ``BRANCHING`` children each."""
    first = N_ROOTS
    width = np.uint64(N_COORDS - first)
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        sig = _signatures(batch.column(2))
        at = np.arange(len(node))
        picks, kids = [], []
        for j in range(BRANCHING):
            c = first + (mix64(node.view(np.uint64) + np.uint64(j + 1)) % width).astype(np.int64)
            for earlier in picks:
                c = np.where(c == earlier, first + (c - first + 1) % int(width), c)
            picks.append(c)
            kids.append(_node_keys(node, c, sig[at, c]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(kids), pa.int64()),
             *[pa.concat_arrays([batch.column(c)] * BRANCHING) for c in (1, 3)]],
            names=["node", "v", "part"])


def _least_agreement(threshold: float, miss: float = 1e-6) -> int:
    """Largest count such that agreement below it has probability < ``miss`` at the threshold."""
    p, total = (1 - threshold) ** N_COORDS, 0.0
    for k in range(N_COORDS + 1):
        total += p
        if total >= miss:
            return k
        p *= (N_COORDS - k) / (k + 1) * threshold / (1 - threshold)
    return N_COORDS


def _likely(sig: np.ndarray, mask: np.ndarray, block: np.ndarray, part: np.ndarray, coord: int,
            least: int) -> np.ndarray:
    """Indexes of a node's documents that have a partner in it worth confirming there,
    of another component (``part``).

    ``mask`` has bit c set where the document's root node c is small.  A root node
    (``coord`` >= 0) takes the pairs whose first common small root it is; a node below a
    large root (``coord`` < 0) those with no common small root at all.
    """
    n, first = len(sig), coord if coord >= 0 else N_ROOTS
    small = ((mask[:, None] >> np.arange(first)) & 1).astype(bool)
    if n <= 16:
        same = sig[:, None, :] == sig[None, :, :]
        agree = same.sum(axis=2)
        earlier = (same[:, :, :first] & small[:, None, :]).any(axis=2)
    else:
        agree = np.zeros((n, n), dtype=np.uint8)
        earlier = np.zeros((n, n), dtype=bool)
        for c in range(N_COORDS):
            same = sig[:, c][:, None] == sig[:, c][None, :]
            agree += same
            if c < first:
                earlier |= same & small[:, c][:, None]
    ok = (agree >= least) & ~earlier & (part[:, None] != part[None, :])
    if block.min() != block.max():
        ok &= block[:, None] != block[None, :]
    return np.flatnonzero(ok.any(axis=1))


def _lists(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column of integers."""
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _flag(least: int):
    """(group, v) of the documents of a node that have a partner there worth confirming."""
    def run(batches):
        for batch in batches:
            at, v = _lists(batch, "v")
            _, mask = _lists(batch, "mask")
            _, block = _lists(batch, "block")
            _, part = _lists(batch, "part")
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            coords = batch.column("coord").to_numpy(zero_copy_only=False)
            sig = _signatures(batch.column("sig").values)
            out_group, out_v = [], []
            for r in range(batch.num_rows):
                lo, hi = at[r], at[r + 1]
                k = _likely(sig[lo:hi], mask[lo:hi], block[lo:hi], part[lo:hi],
                            int(coords[r]), least)
                if len(k):
                    out_v.append(v[lo:hi][k])
                    out_group.append(np.full(len(k), groups[r]))
            none = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_group or none), pa.int64()),
                 pa.array(np.concatenate(out_v or none), pa.int64())], names=["group", "v"])
        trim_memory()
    return run


def _similar(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs with 100 * intersection >= percent * union (sets not empty).

    Shingles that only one set holds cannot count in an intersection; the others
    form an incidence matrix whose products, taken in column blocks, are the exact
    intersection sizes (float32 is exact up to 2^24 a block).
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 4:
        hit = [(i, j) for i in range(n) for j in range(i + 1, n)
               if (c := jaccard_counts(sets[i], sets[j]))[1] and 100 * c[0] >= percent * c[1]]
        return (np.array([i for i, _ in hit], dtype=np.int64),
                np.array([j for _, j in hit], dtype=np.int64))
    values, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = held > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, at = owner[use], column[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    inter = np.zeros((n, n), dtype=np.int32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        grid = np.zeros((n, 4096), dtype=np.float32)
        grid[owner[a:b], at[a:b] - lo] = 1
        inter += (grid @ grid.T).astype(np.int32)
    union = sizes[:, None] + sizes[None, :] - inter
    return np.nonzero(np.triu((inter * 100.0 >= percent * union) & (union > 0), 1))


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A subset of the pairs that joins the same vertices."""
    root, kept = list(range(n)), []
    for x, y in zip(i.tolist(), j.tolist()):
        fx, fy = x, y
        while root[fx] != fx:
            root[fx] = root[root[fx]]
            fx = root[fx]
        while root[fy] != fy:
            root[fy] = root[root[fy]]
            fy = root[fy]
        if fx != fy:
            root[fx] = fy
            kept.append((x, y))
    return kept


def _confirm(percent: int):
    """Spanning links of a node's flagged documents, from their full sets."""
    def run(batches):
        for batch in batches:
            at, v = _lists(batch, "v")
            texts = batch.column("text").values
            a, b = [], []
            for r in range(batch.num_rows):
                lo, hi = int(at[r]), int(at[r + 1])
                sets = [shingle_set(texts[k].as_py()) for k in range(lo, hi)]
                for x, y in _spanning(hi - lo, *_similar(sets, percent)):
                    a.append(v[lo + x])
                    b.append(v[lo + y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim_memory()
    return run


def _sized(members: DataFrame, name: str) -> DataFrame:
    """Members of nodes that hold two components or more, with the node's size."""
    members = materialize(members, f"{name}-members")
    sizes = materialize(members.groupBy("node").agg(
        F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        .where("lo <> hi").select("node", "size"), f"{name}-sizes")
    return materialize(members.join(sizes, "node"), f"{name}-sized")


def _compared(dealt: DataFrame, vectors: DataFrame, masks: DataFrame, leads: DataFrame,
              texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of ``dealt(group, v, part, coord, block)``, a spanning set per group."""
    least = _least_agreement(percent / 100)
    gathered = (dealt.join(vectors, "v").join(masks, "v", "left")
                .withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
                .groupBy("group").agg(F.first("coord").alias("coord"), *[
                    F.collect_list(c).alias(c) for c in ("v", "mask", "block", "part", "sig")]))
    flagged = materialize(gathered.mapInArrow(_flag(least), "group long, v long"), "flagged")
    wanted = leads.join(flagged.select("v").distinct(), "v")
    # one exchange of the texts whatever the share wanted, so that cost follows the input
    found = texts.hint("merge").join(wanted, ["doc_id", "text_hash"]).select("v", "text")
    full = flagged.join(found, "v").groupBy("group").agg(
        F.collect_list("v").alias("v"), F.collect_list("text").alias("text"))
    return materialize(full.mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_duplicate_links(signed: DataFrame, texts: DataFrame, *, percent: int = 75,
                         leaf: int = LEAF) -> DataFrame:
    """Spanning links ``(a, b)`` between the sets of ``signed``, one row each.

    ``signed``: ``v, doc_id, text_hash, sig, roots`` with a ``v`` of its own for every
    set; ``texts``: ``doc_id, text_hash, text``, where a set's text is found by both.
    """
    leads = signed.select("v", "doc_id", "text_hash")
    vectors = signed.select("v", "sig")
    rooted = _sized(signed.select("v", F.col("v").alias("part"),
                                  F.posexplode("roots").alias("coord", "node")), "root")
    masks = materialize(
        rooted.where(F.col("size") <= leaf).groupBy("v")
        .agg(F.expr("bit_or(shiftleft(1L, coord))").alias("mask")), "masks")
    zero = F.lit(0)
    small = rooted.where(F.col("size") <= leaf).select(
        F.col("node").alias("group"), "v", "part", F.col("coord").cast("int"),
        zero.alias("block"))
    large = rooted.where(F.col("size") > leaf).select("node", "v", "part", "size")
    if large.isEmpty():
        return _compared(small, vectors, masks, leads, texts, percent)

    half = leaf // 2
    blocks = F.ceil(F.col("size") / half).cast("int")
    centre = F.array_contains("centres", F.col("v"))
    centres = materialize(
        large.groupBy("node", F.pmod(F.xxhash64("v"), F.lit(CENTRES)).alias("turn"))
        .agg(F.min_by("v", F.xxhash64("v", "node")).alias("v"))
        .groupBy("node").agg(F.collect_list("v").alias("centres")), "centres")
    at = F.pmod(F.xxhash64("v", "node"), blocks)
    spread = large.join(centres, "node").select(
        "node", "v", "part", F.explode(F.when(centre, F.sequence(zero, blocks - 1))
                                       .otherwise(F.array(at.cast("int")))).alias("at"))
    bulk = spread.select(F.xxhash64("node", "at").alias("group"), "v", "part",
                         F.lit(-1).alias("coord"), zero.alias("block"))
    links = _compared(small.union(bulk), vectors, masks, leads, texts, percent)
    parts = materialize(connected_components(links).select(
        F.col("node").alias("v"), F.col("component").alias("part")), "parts")
    vectors = materialize(vectors.join(parts, "v", "left").select(
        "v", F.coalesce("part", "v").alias("part"), "sig"), "vectors")
    handled = materialize(
        rooted.where(F.col("size") <= EXHAUST).groupBy("v")
        .agg(F.expr("bit_or(shiftleft(1L, coord))").alias("mask")), "handled")

    level = _sized(rooted.where(F.col("size") > leaf).select("node", "v", "coord").join(
        vectors.select("v", "part"), "v"), "mixed")
    leaves = []
    for depth in range(MAX_DEPTH + 1):
        last = depth == MAX_DEPTH
        leaves.append(_block_pairs(level if last else level.where(F.col("size") <= EXHAUST)))
        large = level.where(F.col("size") > EXHAUST)
        if last or large.isEmpty():
            break
        kids = large.select("node", "v").join(vectors, "v").select(
            "node", "v", "sig", "part").mapInArrow(_branch, "node long, v long, part long")
        level = _sized(kids.withColumn("coord", F.lit(-1)), f"level{depth + 1}")
    rest = leaves[0]
    for more in leaves[1:]:
        rest = rest.union(more)
    return links.union(_compared(rest, vectors.drop("part"), handled, leads, texts, percent))


def _block_pairs(members: DataFrame) -> DataFrame:
    """Nodes as groups of one block, or of two blocks each where they have more than two."""
    blocks = F.when(F.col("size") <= 2 * BLOCK, 1).otherwise(
        F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = (members.withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return dealt.select(
        F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
        .alias("group"), "v", "part", "coord", "block")


def _sets(docs: DataFrame, percent: int, leaf: int, doc_id: Column):
    """Signed rows, the rows with words and their set ``v``, the links between sets.

    Every distinct set is a vertex of its own; equal texts of one id are told apart from
    its other texts by ``text_hash``.
    """
    spark = docs.sparkSession
    bound_batches(spark, GROUPS_PER_BATCH)
    text = F.col("text").cast("string")
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        text.alias("text"))
    same_set = ["n_shingles", "fp1", "fp2"]
    signed = materialize(texts.mapInArrow(_sign, _SIGNED), "signatures")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        linked.groupBy(*same_set).agg(F.min(F.struct("doc_id", "text_hash")).alias("lead"))
        .select(*same_set, "lead.*", F.monotonically_increasing_id().alias("v")), "classes")
    named = materialize(
        linked.select("doc_id", "text_hash", *same_set)
        .join(classes.select(*same_set, "v", F.col("doc_id").alias("class_id")), same_set)
        .select("doc_id", "text_hash", "n_shingles", "class_id", "v"), "named")
    leaders = materialize(
        linked.join(classes, ["doc_id", "text_hash", *same_set]).dropDuplicates(["v"])
        .select("v", "doc_id", "text_hash", "sig", "roots"), "leaders")
    repeated = linked.groupBy("doc_id", "text_hash").count().where("count > 1")
    contents = texts if repeated.isEmpty() else texts.dropDuplicates(["doc_id", "text_hash"])
    links = near_duplicate_links(leaders, contents, percent=percent, leaf=leaf)
    return signed, classes.select("v", "doc_id", "text_hash"), named, links


def minhash_near_duplicates(docs: DataFrame, *, percent: int = 75, leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for every row of ``docs``.

    ``class_id``: the smallest doc_id with an equal shingle set.  Rows that share a
    doc_id are one document: its links are those of all its texts.  Null, empty and
    blank texts have no shingles and link with nothing.  A null doc_id cannot be
    linked or named: such a row keeps null ids and ``kept`` true.  Extra columns are
    ignored; an empty table gives no rows.
    """
    signed, classes, named, links = _sets(docs, percent, leaf, F.col("doc_id").cast("long"))
    several = (named.groupBy("doc_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
               .where("lo <> hi").select("doc_id", "lo"))
    same_id = named.join(several, "doc_id").select(F.col("v").alias("a"), F.col("lo").alias("b"))
    found = materialize(connected_components(links.union(same_id)), "components")
    least = materialize(
        found.join(classes.withColumnRenamed("v", "node"), "node").groupBy("component")
        .agg(F.min("doc_id").alias("component_id")).join(found, "component")
        .select(F.col("node").alias("v"), "component_id"), "least")
    out = named.join(least, "v", "left").select(
        "doc_id", "n_shingles", "class_id",
        F.coalesce("component_id", "class_id").alias("component_id"))
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Stands for a null doc_id where rows are judged: after every other id.
LAST_ID = 2**63 - 1


def duplicate_rows(docs: DataFrame, *, percent: int = 75, leaf: int = LEAF) -> DataFrame:
    """``doc_id, text_hash`` of the texts that ``deduplicated`` drops, each once.

    Here every text counts for itself, whatever its id: of each group of near-duplicate
    texts the one of the smallest (doc_id, text_hash) stays.  A null doc_id is
    ``LAST_ID``; ``text_hash`` is xxhash64 of the text.
    """
    _, classes, named, links = _sets(
        docs, percent, leaf, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    found = materialize(connected_components(links), "components")
    placed = materialize(classes.join(found.withColumnRenamed("node", "v"), "v", "left").select(
        "v", F.coalesce("component", "v").alias("component"),
        F.struct("doc_id", "text_hash").alias("lead")), "placed")
    stays = placed.groupBy("component").agg(F.min("lead").alias("stays"))
    verdict = placed.join(stays, "component").select("v", "stays")
    return (named.join(verdict, "v").where(F.struct("doc_id", "text_hash") != F.col("stays"))
            .select("doc_id", "text_hash").distinct())


def deduplicated(docs: DataFrame, *, percent: int = 75) -> DataFrame:
    """``docs`` with one row of every group of near-duplicate texts, its columns unchanged.

    Rows are judged by their own text, so that an unlike text under the same doc_id
    stays; rows that repeat a doc_id and a text are one.  Rows without a word all stay.
    """
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(words).withColumns({
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
        "_hash": F.xxhash64(F.col("text").cast("string"))})
    dropped = duplicate_rows(docs, percent=percent).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    once = keyed.dropDuplicates(["_id", "_hash"])
    kept = once.hint("merge").join(dropped, ["_id", "_hash"], "left_anti")
    return kept.select(*docs.columns).union(docs.where(~words))
