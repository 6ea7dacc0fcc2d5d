"""Row index within a group and next-row lookups without a per-group window.

``lead``/``lag`` over ``Window.partitionBy(key)`` sort a whole group in one
task; a group holding a third of the data would be one task.  Here the 0-based
position is a two-phase prefix count (buckets of the order key, see
``scan``), and neighbours are found by an equi-join on ``(key, idx + k)``,
which hashes on both columns, so a hot group spreads over every partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.scan import prefix_aggregate


def row_index(df: DataFrame, partition_by: list[str], order_by: list[str],
              out_col: str = "idx", n_buckets: int | None = None,
              keep_bucket: bool = False) -> DataFrame:
    """0-based position of every row inside its group in ``order_by`` order.

    ``keep_bucket`` keeps the order bucket so that later scans in the same
    order can reuse it (``prefix_aggregate(reuse_bucket=True)``).
    """
    return prefix_aggregate(df, order_by, {out_col: ("count", F.lit(1))},
                            partition_by=partition_by, inclusive=False, n_buckets=n_buckets,
                            keep_bucket=keep_bucket)


def with_neighbours(indexed: DataFrame, partition_by: list[str], wanted: Column,
                    neighbours: dict[str, tuple[int, Column]], cols: list[str],
                    idx_col: str = "idx") -> DataFrame:
    """The rows that satisfy ``wanted``, each with a struct of ``cols`` of some neighbours.

    ``neighbours`` maps output name -> (k, condition): the row ``k`` places on in the group
    (back, if negative) where it satisfies ``condition``, else NULL.  A row goes to the slot
    of every row that it serves, once per part it plays there, and nowhere else: wide columns
    cross the network in one exchange and only where they are used.  A slot holds at most one
    row a part, whatever the size of the group.  Rows without a group have no neighbours.
    """
    at, grouped = F.col(idx_col), F.lit(True)
    for c in partition_by:
        grouped = grouped & F.col(c).isNotNull()
    parts = [F.when(wanted, F.struct(at.alias("slot"), F.lit(0).alias("part")))]
    parts += [F.when(grouped & condition, F.struct((at - k).alias("slot"), F.lit(n).alias("part")))
              for n, (k, condition) in enumerate(neighbours.values(), 1)]
    dealt = indexed.withColumn("_to", F.explode(F.array_compact(F.array(*parts)))).select(
        *indexed.columns, F.col("_to.slot").alias("_slot"), F.col("_to.part").alias("_part"))
    slot = Window.partitionBy(*partition_by, "_slot").orderBy("_part")
    row = F.struct("_part", *cols)
    after = dealt.select(*indexed.columns, "_part", *[
        F.lead(row, j).over(slot).alias(f"_after{j}") for j in range(1, len(parts))])
    return after.where("_part = 0").select(*indexed.columns, *[
        F.coalesce(*[F.when(F.col(f"_after{j}._part") == n, F.col(f"_after{j}"))
                     for j in range(1, n + 1)]).alias(name)
        for n, name in enumerate(neighbours, 1)])


def with_previous(indexed: DataFrame, partition_by: list[str], cols: list[str],
                  idx_col: str = "idx") -> DataFrame:
    """Add ``{col}_prev`` = value of ``col`` one row earlier (NULL for the first row)."""
    prev = indexed.select(*partition_by, (F.col(idx_col) + 1).alias(idx_col),
                          *[F.col(c).alias(f"{c}_prev") for c in cols])
    return indexed.join(prev, on=[*partition_by, idx_col], how="left")
