"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors.

On unit vectors cosine >= t is a Euclidean distance <= sqrt(2 - 2t).  A table files a
vector under some Gaussian projections, shifted at random and quantised to
``WIDTH``; vectors in one cell of any table are compared by exact cosine in double
precision.  The number of tables follows from the wanted recall: a pair at the very
threshold is missed by all of them with probability ``1 - recall``, closer pairs far
less often.

``PROJECTIONS`` is the least number; a larger table gets more, so that unrelated
vectors of the commonest label still share a cell of about ``CELL`` members.

Equal vectors of a label are one row with their number as its weight, so copies cost
what one vector costs and the links among them are counted, not compared.

Cells are dealt in blocks: the members of a cell are spread over ``ceil(n / BLOCK)``
blocks by hash and every pair of blocks is one group of at most 2 * ``BLOCK`` rows or
so, so a hot cell becomes many small tasks.  A pair counts in the first table where
both share a cell.  Only counts per vector and a spanning set of links leave a task,
never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.shingles import mix64
from quire.session import bound_batches, materialize

PROJECTIONS = 8
CELL = 128
WIDTH = 3.0
RECALL = 0.9999
BLOCK = 256
SEED = 2477
#: Groups that go to a Python worker at a time, and the owner of a row that several ids share.
GROUPS_PER_BATCH = 500
NO_OWNER = -2**63


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection agrees at this distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return (math.erf(r / math.sqrt(2))
            - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2)))


def projections_needed(rows: int) -> int:
    """Projections that spread ``rows`` vectors at right angles over cells of ``CELL``."""
    apart = -math.log(same_cell(math.sqrt(2)))
    return max(PROJECTIONS, round(math.log(max(1, rows / CELL)) / apart))


def tables_needed(threshold: float, projections: int, recall: float = RECALL) -> int:
    """Tables after which a pair at the threshold is missed with probability 1 - recall."""
    p = same_cell(math.sqrt(max(0.0, 2 - 2 * threshold))) ** projections
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _usable(column, kind: str):
    """Indexes of the usable vectors of a list column, by length, and their components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    size = np.diff(column.offsets.to_numpy())  # a null component becomes nan
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    ends = start + size
    use = (size > 0) & (bad[ends] == bad[start]) & (some[ends] > some[start])
    for dim in np.unique(size[use]):
        at = np.flatnonzero(use & (size == dim))
        yield int(dim), at, flat[start[at][:, None] + np.arange(dim)]


def _cells(n_tables: int, projections: int, kind: str):
    """(v, label, embedding) -> raw vectors with a 32-bit name of their cell in every table."""
    def run(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, at, x in _usable(batch.column(2), kind):
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim])
                    planes[dim] = (rng.standard_normal((dim, n_tables * projections)),
                                   rng.uniform(0, WIDTH, n_tables * projections))
                a, b = planes[dim]
                q = np.floor((_unit(x) @ a + b) / WIDTH).astype(np.int64)
                q = q.reshape(len(at), n_tables, projections).view(np.uint64)
                code = np.full((len(at), n_tables), dim, dtype=np.uint64)
                for k in range(projections):
                    code = mix64(code + q[:, :, k])
                code = (code >> np.uint64(32)).astype(np.uint32)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary())],
                    names=["v", "label", "vector", "codes"])
    return run


def _members(n_tables: int):
    """(row, label hash, codes) -> (row, table, cell)."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()),
                                  dtype=np.uint32).reshape(n, n_tables).astype(np.uint64)
            label = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            tables = np.arange(n_tables)
            cell = mix64(mix64(label[:, None] + tables.astype(np.uint64)[None, :]) + codes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n_tables)),
                 pa.array(np.tile(tables, n), pa.int32()),
                 pa.array(cell.view(np.int64).ravel(), pa.int64())],
                names=["row", "table", "cell"])
    return run


def _joined(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric link matrix, for every index."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        fresh = np.minimum(label, near)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _rows(column, lo: int, hi: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.slice(lo, hi - lo).to_pylist()),
                         dtype=kind).reshape(hi - lo, -1)


def _compare(threshold: float, kind: str):
    """Blocks of a table's cell -> (row, n, other): links counted here, one spanning link."""
    def run(batches):
        names = ("row", "owner", "weight", "block", "label", "vector", "codes")
        for batch in batches:
            lists = {k: batch.column(k).values for k in names}
            at = batch.column("row").offsets.to_numpy()
            ids, owners, weights, block, labels = (
                lists[k].to_numpy(zero_copy_only=False) for k in names[:5])
            tables = batch.column("table").to_numpy(zero_copy_only=False)
            out = [[], [], []]
            for r in range(batch.num_rows):
                lo, hi = int(at[r]), int(at[r + 1])
                length = {len(x.as_py()) for x in lists["vector"].slice(lo, hi - lo)}
                if len(length) > 1:  # cells of unlike lengths whose names agree by chance
                    raise ValueError("vectors of one cell differ in length")
                x = _unit(_rows(lists["vector"], lo, hi, kind))
                linked = x @ x.T >= threshold
                row, blocks, label, owner = (a[lo:hi] for a in (ids, block, labels, owners))
                linked &= (row[:, None] != row[None, :]) & (label[:, None] == label[None, :])
                linked &= (owner[:, None] != owner[None, :]) | (owner[:, None] == NO_OWNER)
                if blocks.min() != blocks.max():  # equal blocks meet in their own group
                    linked &= blocks[:, None] != blocks[None, :]
                if not linked.any():
                    continue
                code = _rows(lists["codes"], lo, hi, np.uint32)
                for t in range(int(tables[r])):  # counted in the first table they share
                    linked &= code[:, t][:, None] != code[:, t][None, :]
                some = np.flatnonzero(linked.any(axis=1))
                if len(some):
                    least = _joined(linked)
                    out[0].append(row[some])
                    out[1].append((linked @ weights[lo:hi])[some])
                    out[2].append(row[least[some]])
            none = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x or none), pa.int64()) for x in out],
                names=["row", "n", "other"])
    return run


def embedding_near_duplicates(vectors: DataFrame, *, threshold: float = 0.93,
                              recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors link when their labels are equal and not null, their lengths are equal and
    their cosine is at least ``threshold``.  Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, neither does a null vec_id (its
    component is null and it is kept).  Rows of one vec_id are one vertex; equal ones
    count once, unlike ones each by its own links.  Other columns are ignored; an empty
    table gives no rows.
    """
    given = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "<f4" if given == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("v"),
                          F.col("label").cast("string").alias("label"), "embedding")
    usable = rows.where("v IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    commonest = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections = projections_needed(commonest)
    n_tables = tables_needed(threshold, projections, recall)
    bound_batches(vectors.sparkSession, GROUPS_PER_BATCH)
    filed = materialize(
        usable.mapInArrow(_cells(n_tables, projections, kind),
                          "v long, label string, vector binary, codes binary")
        .select("v", F.xxhash64("label", F.octet_length("vector")).alias("label"), "vector",
                "codes", F.md5(F.concat(F.encode(F.concat("label", F.lit("\0")), "utf-8"), "vector"))
                .alias("same")), "filed")
    # equal vectors are one row with a weight; an id with several has rows of its own
    held = materialize(filed.select("v", "same").distinct(), "held")
    several = held.groupBy("v").count().where("count > 1").select("v", F.col("v").alias("own"))
    owner = F.coalesce("own", F.lit(NO_OWNER).cast("long")).alias("owner")
    held = materialize(held.join(several, "v", "left").select("v", "same", owner), "owned")
    weights = held.groupBy("same", "owner").agg(F.count("*").alias("weight"))
    rows_of = materialize(weights.withColumn("row", F.monotonically_increasing_id()), "weights")
    once = filed.groupBy("same").agg(*[F.first(c).alias(c) for c in ("label", "vector", "codes")])
    filed = materialize(rows_of.join(once, "same").drop("same"), "represented")
    members = materialize(filed.select("row", "label", "codes").mapInArrow(
        _members(n_tables), "row long, table int, cell long"), "members")
    sizes = materialize(members.groupBy("table", "cell").agg(F.count("*").alias("size"))
                        .where("size > 1"), "sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (members.join(sizes, ["table", "cell"])
             .withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("row", "table", "block", F.xxhash64(
                 "table", "cell", F.least("block", "other"), F.greatest("block", "other"))
                 .alias("group")))
    grouped = dealt.join(filed, "row").groupBy("group", "table").agg(
        *[F.collect_list(c).alias(c)
          for c in ("row", "owner", "weight", "block", "label", "vector", "codes")])
    links = materialize(grouped.mapInArrow(_compare(threshold, kind),
                                           "row long, n long, other long"), "links")
    counts = links.groupBy("row").agg(F.sum("n").alias("n"))
    own = held.join(rows_of, ["same", "owner"]).select("v", "row", "weight")
    first = own.groupBy("v").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    same_id = own.join(first.where("lo <> hi"), "v").select("row", F.col("lo").alias("other"))
    parts = connected_components(links.select("row", "other").union(same_id), "row", "other")
    placed = materialize(
        own.join(counts, "row", "left").join(parts.withColumnRenamed("node", "row"), "row", "left")
        .select("v", F.coalesce("component", "row").alias("part"),
                (F.coalesce("n", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n")), "placed")
    found = placed.groupBy("v").agg(F.sum("n").alias("n"), F.min("part").alias("part")).join(
        placed.groupBy("part").agg(F.min("v").alias("component")), "part")
    return (rows.select("v").join(found, "v", "left")
            .select(F.col("v").alias("vec_id"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component", "v").alias("component_id"),
                    F.coalesce(F.col("v") == F.coalesce("component", "v"), F.lit(True))
                    .alias("kept")))
