"""Sharding: minimax contiguous partition of atomic groups.

Documents with equal texts form a group, groups stand in corpus order (their
smallest doc_id), and the ordered groups are cut into ``n_shards`` runs so that the
largest run has as few bytes as possible.  The smallest feasible capacity is found
by binary search, each capacity being checked greedily from left to right.

The groups and their running sums stay distributed.  The greedy check only asks
"the last group end at or below x", so the driver keeps a picture of the axis of
running sums: at most ``CELLS`` cells with the least and greatest group end in
each.  A check is run with the picture's optimistic and pessimistic answers; only
where they disagree are the few cells asked about split again by one Spark job.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import materialize

CELLS = 4096


class _Ends:
    """Cells ``[least end, greatest end, number of ends]`` in order, split on demand."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups = groups
        self.total = total
        self.cells = self._split([(1, total)])
        self._index()

    def _split(self, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The non-empty cells of each span of ends, at most ``CELLS`` in all."""
        each = max(2, CELLS // len(spans))
        cell = F.lit(None).cast("long")
        chosen = F.lit(False)
        for k, (lo, hi) in enumerate(spans):
            width = (hi - lo) // each + 1
            inside = F.col("end").between(lo, hi)
            chosen = chosen | inside
            cell = F.when(inside, F.lit(k * each) + F.floor((F.col("end") - lo) / width)) \
                .otherwise(cell)
        rows = (self.groups.where(chosen).groupBy(cell.alias("cell"))
                .agg(F.min("end"), F.max("end"), F.count("*")).collect())
        return sorted((r[1], r[2], r[3]) for r in rows)

    def _index(self) -> None:
        self.least = [c[0] for c in self.cells]

    def refine(self, asked: set[int]) -> None:
        """Split the cells at these indexes."""
        ids = sorted(asked)
        fresh = self._split([self.cells[i][:2] for i in ids])
        keep = [c for i, c in enumerate(self.cells) if i not in asked]
        self.cells = sorted(keep + fresh)
        self._index()

    def below(self, x: int) -> tuple[int, int, int | None]:
        """(pessimistic, optimistic) last end <= x, and the cell that would decide."""
        k = bisect.bisect_right(self.least, x) - 1
        if k < 0:
            return 0, 0, None
        lo, hi, n = self.cells[k]
        if x >= hi:
            return hi, hi, None
        if n <= 2:  # both ends are known
            return lo, lo, None
        return lo, x, k

    def above(self, x: int) -> tuple[int, int | None]:
        """First end >= x, from above, and the cell that would decide."""
        k = bisect.bisect_right(self.least, x) - 1
        if k >= 0:
            lo, hi, n = self.cells[k]
            if x == lo:
                return lo, None
            if x <= hi:
                return hi, (None if n <= 2 or x == hi else k)
        return (self.least[k + 1] if k + 1 < len(self.cells) else self.total), None


def _feasible(ends: _Ends, n_shards: int, capacity: int) -> bool:
    """Whether greedy filling needs at most ``n_shards`` runs of ``capacity``."""
    while True:
        low = high = 0
        asked: set[int] = set()
        for _ in range(n_shards):
            (low, _, a), (_, high, b) = ends.below(low + capacity), ends.below(high + capacity)
            asked |= {x for x in (a, b) if x is not None}
        if low >= ends.total:
            return True
        if high < ends.total:
            return False
        ends.refine(asked)


def _exact(ends: _Ends, lookup: str, x: int) -> int:
    while True:
        got = getattr(ends, lookup)(x)
        if got[-1] is None:
            return got[0]
        ends.refine({got[-1]})


def minimax_cuts(groups: DataFrame, n_shards: int, total: int, largest: int) -> list[int]:
    """Running sums (``n_shards - 1`` of them) after which to cut ``groups(end)``.

    The capacity is the smallest feasible one.  Among the cuts that keep to it, each
    is placed as near to its equal share as the groups before and after allow.
    """
    if total <= 0:
        return []
    ends = _Ends(groups, total)
    low, high = max(largest, -(-total // n_shards)), -(-total // n_shards) + largest
    while low < high:
        middle = (low + high) // 2
        if _feasible(ends, n_shards, middle):
            high = middle
        else:
            low = middle + 1
    earliest = [total]  # of the cut after which the remaining shards just suffice
    for _ in range(n_shards - 1):
        earliest.append(_exact(ends, "above", max(0, earliest[-1] - low))
                        if earliest[-1] > low else 0)
    earliest.reverse()
    cuts, at = [], 0
    for k in range(1, n_shards):
        share = -(-total * k // n_shards)
        latest = _exact(ends, "below", at + low)
        under, over = _exact(ends, "below", share), _exact(ends, "above", share)
        best = under if share - under <= over - share else over
        at = max(earliest[k - 1], min(best, latest), at)
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1, ``law`` is ``bytes``: shard
    sizes are as near equal as whole groups allow, no shard above the minimax capacity.
    A null text is a group apart from the empty text.  Null doc_ids come first and
    repeated rows all stay; ``slot`` numbers the rows of a shard from 0 by group, then
    doc_id.  Other columns are ignored and an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    base = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("group")), "shard-rows")
    groups = materialize(
        base.groupBy("group").agg(F.coalesce(F.min("doc_id"), F.lit(-2**63)).alias("first"),
                                  F.sum("size").alias("bytes")), "shard-groups")
    placed = materialize(groups.repartitionByRange("first", "group")
                         .withColumn("part", F.spark_partition_id()), "shard-order")
    parts = placed.groupBy("part").agg(F.sum("bytes").alias("bytes"),
                                       F.max("bytes").alias("largest"))
    offsets, total, largest = [], 0, 0  # one number per partition of the range exchange
    for row in sorted(parts.collect()):
        offsets.append((row["part"], total))
        total, largest = total + row["bytes"], max(largest, row["largest"])
    spark = docs.sparkSession
    before = spark.createDataFrame(offsets, "part int, before long")
    upto = W.partitionBy("part").orderBy("first", "group")
    ordered = materialize(
        placed.withColumn("upto", F.sum("bytes").over(upto)).join(F.broadcast(before), "part")
        .select("group", "first", (F.col("before") + F.col("upto")).alias("end")), "shard-ends")
    cuts = minimax_cuts(ordered, n_shards, total, largest)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("end") > cut).cast("int")
    of_group = materialize(ordered.select("group", "first", shard.alias("shard")),
                           "shard-of-group")
    rows = materialize(
        base.join(of_group, "group")
        .repartitionByRange("first", "group", "doc_id")
        .withColumn("part", F.spark_partition_id()), "sharded-rows")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    start = F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = materialize(counts.select("shard", "part", start.alias("start")), "slot-starts")
    within = F.row_number().over(W.partitionBy("part", "shard")
                                 .orderBy("first", "group", "doc_id", "text_crc32")) - 1
    return (rows.withColumn("within", within).join(starts, ["part", "shard"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("within")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
