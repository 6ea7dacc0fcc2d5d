"""Hard negatives by exact inner products: shared lists of anchor clusters.

Anchors are clustered by angle.  A cluster with direction c whose members lie within the
angle t of c bounds every score of a member a with a row x by

    |a| * |x| * cos(max(0, angle(x, c) - t)),

and the part behind |a| is the same for all members: one list of the rows, sorted by it
once, serves the whole cluster.  A member walks that list from the top and may stop as
soon as the bound of the next row is below what it still needs (its k-th best score so
far, or the lower end of the window that it asks for); nothing behind can change its
answer.

On Spark the list is sorted by buckets: a histogram of the bounds cuts it into bands,
and the walk goes band by band (each ``GROWTH`` times the one before), with only those
members going on that are not certified yet.  A band is compared in blocks of at most about
``MEMBERS`` asking members and ``ROWS`` rows, inside which rows are sorted by bound and
members stop in the same way.  Only the k best of each member leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import materialize

#: Anchors on which the cluster directions are fitted, directions at most, anchors for each.
SAMPLE, CLUSTERS, PER_CLUSTER = 4096, 128, 256
#: Members and rows of a block (a band has ``SPREAD`` blocks before they grow beyond
#: ``LEAST_ROWS``), and rows that are compared at a time.
MEMBERS, ROWS, LEAST_ROWS, SPREAD, CHUNK = 1024, 8192, 512, 16, 512
#: Rows of a list's first band, and how much larger each next one is.
FIRST, GROWTH = 4096, 16
BINS = 256
#: Relative slack on every bound, far above what rounding can take from it.
SLACK = 1e-9

_UNIT = "dim int, cluster int, g int, h int"
_TOP = 2**63 - 1


def _floored(scale: float):
    """Rows -> whole-number vectors; rows with a null or non-finite component go."""
    def run(batches):
        for batch in batches:
            column = batch.column(3)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            size = np.diff(column.offsets.to_numpy())
            start = np.cumsum(size) - size
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            use = (size > 0) & (bad[start + size] == bad[start])
            rows, norm = [], []
            for k in np.flatnonzero(use):
                x = flat[start[k]:start[k] + size[k]]
                most = np.abs(x).max()
                rows.append(x.astype("<f4" if most < 2**24 else "<f8").tobytes())
                norm.append(most * np.sqrt(((x / most) ** 2).sum()) if most else 0.0)
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(keep) for c in (0, 1, 2)],
                 pa.array(size[use].astype(np.int32)), pa.array(norm, pa.float64()),
                 pa.array(rows, pa.binary())],
                names=["v", "label", "anchor", "dim", "norm", "vector"])
    return run


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length as doubles, whichever width each is kept in."""
    if all(len(x) == 4 * dim for x in vectors):
        return np.frombuffer(b"".join(vectors), "<f4").reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8") for x in vectors],
                    dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True)
    x = np.divide(x, most, out=np.zeros_like(x), where=most > 0)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x, where=size > 0)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; beyond those, the nearest one."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1] < 2**53:
        return (a @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in a]
    other = [[int(v) for v in row] for row in x]
    return np.array([[max(-_TOP, min(_TOP, sum(p * q for p, q in zip(u, w)))) for w in other]
                     for u in whole], dtype=np.int64)


def _directions(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` directions of a sample by spherical k-means, the same for the same sample."""
    x = _unit(x)
    found = x[np.random.default_rng(len(x)).permutation(len(x))[:k]].copy()
    for _ in range(8):
        near = (x @ found.T).argmax(axis=1)
        for c in range(len(found)):
            if (near == c).any():
                found[c] = x[near == c].sum(axis=0)
        found = _unit(found)
    return found


def _angles(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ directions.T, -1.0, 1.0))


def _assigned(directions: dict[int, np.ndarray]):
    """Anchors with the cluster of the nearest direction and the angle to it."""
    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            cluster = np.zeros(len(dim), np.int32)
            angle = np.zeros(len(dim))
            vectors = batch.column("vector").to_pylist()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                apart = _angles(_matrix([vectors[k] for k in at], int(d)), directions[int(d)])
                cluster[at] = apart.argmin(axis=1)
                angle[at] = apart.min(axis=1)
            angle[batch.column("norm").to_numpy() == 0] = 0.0  # scores 0 whatever the angle
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "v", "label", "dim", "norm", "vector")],
                 pa.array(cluster), pa.array(angle)],
                names=["row", "v", "label", "dim", "norm", "vector", "cluster", "angle"])
    return run


def _bounds(x: np.ndarray, norm: np.ndarray, direction: np.ndarray, radius: float) -> np.ndarray:
    """What the score with any member of the cluster is at most, over the member's length."""
    apart = np.maximum(0.0, _angles(x, direction[None, :])[:, 0] - radius - 1e-7)
    return norm * np.cos(apart)


class _Lists:
    """The clusters' lists: directions, radii and the bands of their bucket-sorted bounds."""

    def __init__(self, directions, radii, blocks, longest):
        self.directions, self.radii = directions, radii
        self.blocks, self.longest = blocks, longest
        self.bands: dict[tuple[int, int], list[tuple[int, int, float, int]]] = {}

    def bins(self, key: tuple[int, int], bound: np.ndarray) -> np.ndarray:
        width = 2 * self.longest[key[0]] / BINS or 1.0
        return np.clip(((bound + self.longest[key[0]]) / width).astype(np.int64), 0, BINS - 1)

    def cut(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """Bands ``(least bin, greatest bin, greatest bound, blocks of rows)`` from the top."""
        for key, n in counts.items():
            found, want, have, top = [], FIRST, 0, BINS - 1
            width = 2 * self.longest[key[0]] / BINS or 1.0
            for b in range(BINS - 1, -1, -1):
                have += int(n[b])
                if have >= want or (b == 0 and have):
                    edge = (top + 1) * width - self.longest[key[0]]
                    size = min(ROWS, max(LEAST_ROWS, have // SPREAD))
                    found.append((b, top, edge, -(-have // size)))
                    top, have, want = b - 1, 0, want * GROWTH
            self.bands[key] = found

    def of(self, batch, keys):
        """For each key of the batch's lengths: the rows of its length and their bounds."""
        dim = batch.column("dim").to_numpy(zero_copy_only=False)
        norm = batch.column("norm").to_numpy(zero_copy_only=False)
        vectors = batch.column("vector").to_pylist()
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            own = [key for key in keys if key[0] == d]
            if own:
                x = _matrix([vectors[k] for k in at], int(d))
                for key in own:
                    yield key, at, _bounds(x, norm[at], self.directions[key[0]][key[1]],
                                           self.radii[key])


def _histogram(lists: _Lists):
    """Rows -> (dim, cluster, bin, n), summed in the batch."""
    def run(batches):
        for batch in batches:
            out = []
            for key, _, bound in lists.of(batch, lists.radii):
                n = np.bincount(lists.bins(key, bound), minlength=BINS)
                out += [(*key, b, int(n[b])) for b in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in
                 enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                names=["dim", "cluster", "bin", "n"])
    return run


_ROW = "bound double, row long, v long, label long, vector binary"


def _band_rows(lists: _Lists, band: int, keys: list[tuple[int, int]]):
    """Rows -> those of this band of each list, once for every block of members."""
    def run(batches):
        for batch in batches:
            for key, at, bound in lists.of(batch, keys):
                lo, hi, _, blocks = lists.bands[key][band]
                bins = lists.bins(key, bound)
                some = np.flatnonzero((bins >= lo) & (bins <= hi))
                if not len(some):
                    continue
                rows = batch.take(pa.array(at[some]))
                turn = (rows.column("row").to_numpy(zero_copy_only=False) % blocks).astype(np.int32)
                for g in range(lists.blocks[key]):
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, c, np.int32)) for c in (*key, g)]
                        + [pa.array(turn), pa.array(bound[some])]
                        + [rows.column(c) for c in ("row", "v", "label", "vector")],
                        names=["dim", "cluster", "g", "h", "bound", "row", "v", "label", "vector"])
    return run


def _best(asker, score, v, n_askers: int, k: int):
    """Of entries, the ``k`` best of each asker, by score and then smaller id; the k-th scores."""
    order = np.lexsort((v, -score, asker))
    asker, score, v = asker[order], score[order], v[order]
    first = np.searchsorted(asker, np.arange(n_askers))
    rank = np.arange(len(asker)) - first[asker]
    last = np.full(n_askers, -_TOP, np.int64)
    at = np.flatnonzero(rank == k - 1)
    last[asker[at]] = score[at]
    keep = rank < k
    return asker[keep], score[keep], v[keep], last


def _walk_block(same: bool, k: int):
    """Asking members and rows of a block -> the k best rows of each member."""
    def run(members: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["a", "ask", "v", "score"]
        if not members.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = members.column("dim")[0].as_py()
        column = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(-column(rows, "bound"), kind="stable")
        bound = column(rows, "bound")[order]
        row, v, label = (column(rows, c)[order] for c in ("row", "v", "label"))
        x = _matrix([rows.column("vector")[int(i)].as_py() for i in order], dim)
        a, ask, own, low, high, norm, need = (column(members, c) for c in (
            "a", "ask", "label", "low", "high", "norm", "need"))
        at, which = np.unique(a, return_index=True)
        vectors = _matrix([members.column("vector")[int(i)].as_py() for i in which], dim)
        mine = np.searchsorted(at, a)
        n = len(a)
        asker, score, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        least = need.copy()
        for lo in range(0, len(row), CHUNK):
            reach = norm * bound[lo]
            walking = np.flatnonzero(reach + np.abs(reach) * SLACK + SLACK >= least)
            if not len(walking):
                break
            part = slice(lo, lo + CHUNK)
            used, back = np.unique(mine[walking], return_inverse=True)
            s = _scores(vectors[used], x[part])[back]
            ok = (s >= least[walking, None]) & (s <= high[walking, None])
            ok &= (label[part][None, :] == own[walking, None]) == same
            ok &= row[part][None, :] != a[walking, None]
            if s.shape[1] > k:  # what is below the k-th of this chunk alone is out
                best = np.where(ok, s, -_TOP)
                ok &= s >= np.partition(best, -k, axis=1)[:, -k, None]
            i, j = np.nonzero(ok)
            asker, score, ids, last = _best(
                np.concatenate([asker, walking[i]]), np.concatenate([score, s[i, j]]),
                np.concatenate([ids, v[part][j]]), n, k)
            least = np.maximum(least, last)
        return pa.table({"a": a[asker], "ask": ask[asker], "v": ids, "score": score})
    return run


def _walk(asking: DataFrame, rows: DataFrame, lists: _Lists, same: bool, k: int) -> DataFrame:
    """``a, ask, v, score, rank``: the k best rows of each ``(a, ask)`` within ``low..high``.

    Rows of the member's label if ``same``, else of other labels; the member's own row
    never counts.
    """
    spark = rows.sparkSession
    rank = F.row_number().over(W.partitionBy("a", "ask").orderBy(F.desc("score"), "v"))
    found = None
    for band in range(max((len(x) for x in lists.bands.values()), default=0)):
        tops = spark.createDataFrame(
            [(*key, x[band][2], x[band][3]) for key, x in sorted(lists.bands.items())
             if band < len(x)], "dim int, cluster int, top double, blocks int")
        need = F.col("low")
        walking = asking
        if found is not None:
            kth = found.where(F.col("rank") == k).select("a", "ask", F.col("score").alias("kth"))
            walking = asking.join(kth, ["a", "ask"], "left")
            need = F.greatest("low", F.coalesce("kth", "low"))
        reach = F.col("norm") * F.col("top")  # one row a list: a bounded broadcast
        walking = materialize(
            walking.withColumn("need", need).join(F.broadcast(tops), ["dim", "cluster"])
            .where(reach + F.abs(reach) * SLACK + SLACK >= F.col("need")).drop("kth", "top"),
            "walking")
        keys = [(r["dim"], r["cluster"]) for r in
                walking.select("dim", "cluster").distinct().collect()]
        if not keys:  # and none will ask again: later bands reach less far
            break
        members = walking.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        listed = rows.mapInArrow(_band_rows(lists, band, keys), f"{_UNIT}, {_ROW}")
        unit = ["dim", "cluster", "g", "h"]
        fresh = members.groupBy(*unit).cogroup(listed.groupBy(*unit)).applyInArrow(
            _walk_block(same, k), "a long, ask long, v long, score long")
        if found is not None:
            fresh = fresh.union(found.drop("rank"))
        found = materialize(fresh.withColumn("rank", rank).where(F.col("rank") <= k), "found")
    if found is None:
        return spark.createDataFrame([], "a long, ask long, v long, score long, rank int")
    return found


def _lists_of(rows: DataFrame, anchors_of: dict[int, int], longest: dict[int, float]):
    """The anchors with their cluster and block, and the clusters' lists."""
    only = rows.where("anchor")
    directions = {}
    sample = only.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "vector").collect()
    for dim, n in anchors_of.items():
        own = [r["vector"] for r in sample if r["dim"] == dim]
        k = min(CLUSTERS, -(-n // PER_CLUSTER), max(1, len(own)))
        directions[dim] = (_directions(_matrix(own, dim), k) if own else np.zeros((1, dim)))
    anchors = materialize(only.drop("anchor").mapInArrow(
        _assigned(directions), "row long, v long, label long, dim int, norm double, "
                               "vector binary, cluster int, angle double"), "anchors")
    radii, blocks = {}, {}
    for r in anchors.groupBy("dim", "cluster").agg(F.count("*").alias("n"),
                                                   F.max("angle").alias("angle")).collect():
        radii[r["dim"], r["cluster"]] = r["angle"]
        blocks[r["dim"], r["cluster"]] = -(-r["n"] // MEMBERS)
    lists = _Lists(directions, radii, blocks, longest)
    counts = {key: np.zeros(BINS, np.int64) for key in radii}
    for r in rows.drop("anchor").mapInArrow(
            _histogram(lists), "dim int, cluster int, bin int, n long").groupBy(
            "dim", "cluster", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["dim"], r["cluster"]][r["bin"]] = r["n"]
    lists.cut(counts)
    spark = rows.sparkSession
    of = spark.createDataFrame([(*key, n) for key, n in sorted(blocks.items())],
                               "dim int, cluster int, n int")
    dealt = anchors.join(F.broadcast(of), ["dim", "cluster"]).select(
        F.col("row").alias("a"), "v", "label", "dim", "cluster", "norm", "vector",
        F.pmod(F.xxhash64("row"), F.col("n")).cast("int").alias("g"))
    return dealt, lists


def mine_hard_negatives(vectors: DataFrame, anchors: Column, *, scale: float = 256.0,
                        n_positives: int = 5, n_negatives: int = 5, low: int = 80,
                        high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors``: ``vec_id, label, embedding``; ``anchors`` says which rows ask.  A
    component x counts as floor(scale * x), a score is the inner product of those whole
    numbers (clipped to 64 bits), higher scores come first and ties go to the smaller
    vec_id.  An anchor's positives are its first ``n_positives`` other rows of its label;
    a positive's negatives the first ``n_negatives`` rows of other labels whose score is
    ``low`` to ``high`` per cent of its own.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite
    component take no part; vectors of different lengths are never compared.  Every row
    stands for itself: a repeated row is another row, also for its twin.  Zero vectors
    score 0.  Other columns are ignored; no rows or no anchors give no rows.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("the window must lie within 0 to 100 per cent")
    spark = vectors.sparkSession
    given = vectors.withColumn("_anchor", anchors).select(
        F.col("vec_id").cast("long").alias("v"), F.col("label").cast("long").alias("label"),
        F.coalesce("_anchor", F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(
        given.where("v IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .mapInArrow(_floored(scale), "v long, label long, anchor boolean, dim int, norm double, "
                                     "vector binary")
        .withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy("dim").agg(F.count_if("anchor").alias("anchors"),
                                    F.max("norm").alias("norm")).where("anchors > 0").collect()
    if not sizes:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, "
                "positive_score long, negative_score long")
    dealt, lists = _lists_of(rows, {r["dim"]: r["anchors"] for r in sizes},
                             {r["dim"]: r["norm"] for r in sizes})
    dealt = materialize(dealt, "asking")
    every = dealt.select("*", F.lit(0).cast("long").alias("ask"),
                         F.lit(-_TOP).alias("low"), F.lit(_TOP).alias("high"))
    positives = _walk(every.drop("v"), rows, lists, True, n_positives).select(
        "a", F.col("v").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = (positives.where("positive_score >= 0")
               .select("a", F.col("positive_score").alias("ask")).distinct())
    least = F.expr(f"ask div 100 * {low} + (ask % 100 * {low} + 99) div 100")
    most = F.expr(f"ask div 100 * {high} + (ask % 100 * {high}) div 100")
    asking = materialize(
        dealt.drop("v").join(windows, "a").withColumns({"low": least, "high": most}), "windows")
    negatives = _walk(asking, rows, lists, False, n_negatives).select(
        "a", F.col("ask").alias("positive_score"), "rank", F.col("v").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return (positives.join(negatives, ["a", "positive_score"])
            .join(dealt.select("a", F.col("v").alias("anchor_id")), "a")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
