"""Two-phase ordered scans (running sum / min / max / count) without a global window.

``Window.orderBy`` with no partition moves every row into one task.  Instead:

1. bucket = number of splitters at or below the row's whole order key.  The
   splitters are evenly spaced keys of a bounded sample (sample sort), compared
   column by column as Spark itself orders them: strings as a whole, composite
   keys by all their columns.  They are settled once and enter every plan as one
   constant, so each branch of a plan agrees on a row's bucket.
2. in-bucket running aggregate: window partitioned by ``(partition_by, bucket)``.
3. bucket totals (one row per ``(partition_by, bucket)``) are cumulated with a
   small window and joined back; with no or a bounded ``partition_by`` the table
   has at most ``n_buckets * n_keys`` rows and is broadcast.

Buckets stay even whatever the keys' distribution or common prefix; only rows equal
in every order column must share one.  A hot ``partition_by`` value is still split
over all buckets its keys fall in.  The in-bucket order must be total (give a
tiebreak column) for deterministic results.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
MAX_BROADCAST_BUCKET_ROWS = 2_000_000
# Keys sampled for each splitter, and the least and greatest size of the sample.
OVERSAMPLE = 64
LEAST_SAMPLE, GREATEST_SAMPLE = 20_000, 200_000


def default_buckets(spark) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def _orderable(df: DataFrame, name: str) -> Column:
    """The column in a type that JSON can carry, in the same order."""
    kind, key = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        # wall-clock values: no time-zone conversion (it is not monotone across DST)
        key = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), key)
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    elif isinstance(kind, T.DateType):
        key = F.unix_date(key)
    elif isinstance(kind, T.BinaryType):
        key = F.hex(key)
    return key


def _in_spark_order(value):
    """A Python sort key that orders collected values as Spark does."""
    if value is None:
        return (0, 0)
    if isinstance(value, str):
        return (1, value.encode("utf-8", "surrogatepass"))
    if isinstance(value, float) and math.isnan(value):
        return (2, 0)
    return (1, value)


def _sampled_keys(keys: DataFrame, n_buckets: int) -> list[tuple]:
    """A sample of the keys, in order: all of a small table, else about evenly drawn rows."""
    size = min(max(OVERSAMPLE * n_buckets, LEAST_SAMPLE), max(GREATEST_SAMPLE, 8 * n_buckets))
    rows = keys.take(size + 1)
    if len(rows) > size:
        share = size / keys.count()
        rows = keys.sample(withReplacement=False, fraction=min(1.0, share), seed=size).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(_in_spark_order, r)))


def key_splitters(keys: DataFrame, n_buckets: int) -> list[tuple]:
    """At most ``n_buckets - 1`` distinct keys that cut a sample of ``keys`` into even runs."""
    found = _sampled_keys(keys, n_buckets)
    picked = [found[len(found) * k // n_buckets] for k in range(1, n_buckets)] if found else []
    return [x for x, before in zip(picked, [None, *picked]) if x != before]


def _constant(splitters: list[tuple], kind: T.StructType) -> Column:
    """The splitters as one constant array of structs."""
    rows = [{f.name: str(v) if isinstance(v, Decimal) else v for f, v in zip(kind.fields, row)}
            for row in splitters]
    return F.from_json(F.lit(json.dumps(rows)), T.ArrayType(kind))


def bucket_of(key: Column, splitters: Column, n: int) -> Column:
    """Number of the ``n`` ascending ``splitters`` at or below ``key``, by binary search."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    # the key travels in the state: an optimizer rule overlooks columns used inside lambdas
    start = F.struct(F.lit(0).alias("at"), key.alias("key"))
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), start,
        lambda s, step: F.struct(
            (s["at"] + F.when((s["at"] + step <= n)
                              & (F.get(splitters, s["at"] + step - 1) <= s["key"]), step)
             .otherwise(F.lit(0))).alias("at"), s["key"].alias("key")),
        lambda s: s["at"])


def add_order_bucket(df: DataFrame, order_by: list[str] | str, n_buckets: int | None = None,
                     out_col: str = BUCKET, quantile_source: DataFrame | None = None) -> DataFrame:
    """Add the bucket id of the whole order key (numbers, strings, binaries, dates, timestamps).

    ``quantile_source`` (a cheap DataFrame with the same key columns, e.g. the raw
    table ``df`` was derived from) is sampled instead of ``df``: any splitters give
    correct buckets, only their balance depends on them, and an expensive ``df`` is
    then not recomputed for the sample.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    nb = n_buckets or default_buckets(df.sparkSession)
    source = df if quantile_source is None else quantile_source
    keys = source.select(*[_orderable(source, c).alias(f"k{i}") for i, c in enumerate(order)])
    splitters = key_splitters(keys, nb) if nb > 1 else []
    if not splitters:
        return df.withColumn(out_col, F.lit(0))
    key = F.struct(*[_orderable(df, c).cast(f.dataType).alias(f.name)
                     for c, f in zip(order, keys.schema.fields)])
    return df.withColumn(out_col, bucket_of(key, _constant(splitters, keys.schema),
                                            len(splitters)))


def _window_agg(kind: str, col: Column, w) -> Column:
    if kind in ("sum", "count"):
        return F.sum(col).over(w)
    if kind == "min":
        return F.min(col).over(w)
    if kind == "max":
        return F.max(col).over(w)
    raise ValueError(kind)


def _group_agg(kind: str, col: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(col)
    if kind == "min":
        return F.min(col)
    if kind == "max":
        return F.max(col)
    raise ValueError(kind)


def _combine(kind: str, base: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(base, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(base, local)  # least/greatest skip NULLs
    return F.greatest(base, local)


def prefix_aggregate(df: DataFrame, order_by: list[str], aggs: dict[str, tuple[str, Column]],
                     partition_by: list[str] | None = None, inclusive: bool = False,
                     n_buckets: int | None = None, partition_cardinality: int | None = None,
                     bucketed: DataFrame | None = None, reuse_bucket: bool = False,
                     keep_bucket: bool = False,
                     quantile_source: DataFrame | None = None,
                     n_parts: int | None = None) -> DataFrame:
    """Add running aggregates in ``order_by`` order (per ``partition_by``).

    ``aggs`` maps output name -> (kind, column) with kind in sum/count/min/max.
    ``inclusive=False`` gives the aggregate over strictly earlier rows.
    ``partition_cardinality`` is a proven bound on the distinct values of
    ``partition_by`` (e.g. 2 for split); the bucket-base table then has at most
    ``n_buckets * partition_cardinality`` rows and is broadcast when that is
    small.  Without a bound the join is left to AQE, which only broadcasts it
    when its measured runtime size is small.

    ``reuse_bucket`` takes the ``_bucket`` column already on ``df`` (from an
    earlier scan with ``keep_bucket``); valid when that bucket is monotone in the
    new order within each partition - chained scans over one ordering then share
    one sample pass and one shuffle.

    ``n_parts`` deals the rows to that many tasks, by default to
    ``spark.sql.shuffle.partitions``: callers whose rows are wide give a number that
    grows with their bytes (and as many buckets), so that a task's share does not.
    """
    pb = list(partition_by or [])
    if reuse_bucket and BUCKET in df.columns:
        b = df
    else:
        b = bucketed if bucketed is not None else add_order_bucket(
            df, order_by, n_buckets, quantile_source=quantile_source)
    inputs = {name: (kind, (F.lit(1) if kind == "count" else col))
              for name, (kind, col) in aggs.items()}
    for name, (kind, col) in inputs.items():
        b = b.withColumn(f"_in_{name}", col)

    grp = pb + [BUCKET]
    totals = b.groupBy(*grp).agg(*[_group_agg(k, F.col(f"_in_{n}")).alias(f"_t_{n}")
                                   for n, (k, _) in inputs.items()])
    wb = Window.partitionBy(*pb).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*grp, *[_window_agg(k, F.col(f"_t_{n}"), wb).alias(f"_base_{n}")
                                 for n, (k, _) in inputs.items()])
    card = 1 if not pb else partition_cardinality
    if card is not None:
        if (n_buckets or default_buckets(df.sparkSession)) * card <= MAX_BROADCAST_BUCKET_ROWS:
            base = F.broadcast(base)

    w = Window.partitionBy(*grp).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    dealt = b.repartition(n_parts, *grp) if n_parts else b
    local = dealt.select("*", *[_window_agg(k, F.col(f"_in_{n}"), w).alias(f"_loc_{n}")
                            for n, (k, _) in inputs.items()])
    joined = local.join(base, on=grp, how="left")
    keep = [c for c in df.columns if c != BUCKET] + ([BUCKET] if keep_bucket else [])
    out = joined.select(
        *keep,
        *[_combine(k, F.col(f"_base_{n}"), F.col(f"_loc_{n}")).alias(n)
          for n, (k, _) in inputs.items()],
    )
    return out
