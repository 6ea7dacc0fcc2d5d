"""Training-run log analysis, per run, without per-run windows.

Run logs are tables ``run_eval(run_id, iter, val_loss, ...)`` and
``run_step(run_id, iter, loss, ts)``.  The reference's sequential loops become
two-phase ordered scans (``scan``) partitioned by run, so even a run holding a
third of all rows is split over buckets of its iterations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.neighbors import row_index, with_previous
from quire.operators.scan import BUCKET, add_order_bucket, prefix_aggregate
from quire.session import materialize
from quire.sources.versions import latest, publish, remove

RUN_EVAL_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), False), T.StructField("iter", T.LongType(), False),
    T.StructField("train_loss", T.DoubleType(), True), T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("lr", T.DoubleType(), True), T.StructField("mfu", T.DoubleType(), True)])
RUN_STEP_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), False), T.StructField("iter", T.LongType(), False),
    T.StructField("micro", T.IntegerType(), True), T.StructField("loss", T.DoubleType(), True),
    T.StructField("ts", T.TimestampType(), True)])

# Fixed value: best loss before the first evaluation.
INITIAL_BEST = 1e9


def at_interval(df: DataFrame, interval: int, iter_col: str = "iter") -> DataFrame:
    """Rows whose iteration is a multiple of ``interval``."""
    return df.where(F.col(iter_col) % interval == 0)


def cap_iterations(df: DataFrame, max_iters: int, iter_col: str = "iter") -> DataFrame:
    """P10: iterations ``0..max_iters`` (the cap is inclusive)."""
    return df.where(F.col(iter_col) <= max_iters)


def mark_improvements(df: DataFrame, run_col: str = "run_id", iter_col: str = "iter",
                      val_col: str = "val_loss", n_buckets: int | None = None) -> DataFrame:
    """``best_before`` (strictly earlier minimum, 1e9 at first) and ``improved``."""
    out = prefix_aggregate(df, [iter_col], {"best_before": ("min", F.col(val_col))},
                           partition_by=[run_col], inclusive=False, n_buckets=n_buckets,
                           reuse_bucket=True, keep_bucket=True)
    out = out.withColumn("best_before", F.coalesce("best_before", F.lit(INITIAL_BEST)))
    return out.withColumn("improved", F.coalesce(F.col(val_col) < F.col("best_before"),
                                                 F.lit(False)))


def with_patience(marked: DataFrame, run_col: str = "run_id", iter_col: str = "iter",
                  pos_col: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """R2: consecutive non-improving evaluations so far (0 right after an improvement).

    Gaps and islands: patience = position - position of the last improvement
    (a running max), or position + 1 before any improvement.
    """
    df = marked
    if pos_col is None:
        df = row_index(df, [run_col], [iter_col], "_pos", n_buckets, keep_bucket=True)
        pos_col = "_pos"
    df = prefix_aggregate(df, [iter_col],
                          {"_last_imp": ("max", F.when(F.col("improved"), F.col(pos_col)))},
                          partition_by=[run_col], inclusive=True, n_buckets=n_buckets,
                          reuse_bucket=True, keep_bucket=True)
    pat = F.when(F.col("_last_imp").isNull(), F.col(pos_col) + 1).otherwise(
        F.col(pos_col) - F.col("_last_imp"))
    out = df.withColumn("patience", pat.cast("bigint")).drop("_last_imp")
    return out.drop("_pos") if pos_col == "_pos" else out


def _earliest_minimum(val_col: str, iter_col: str) -> Column:
    """Struct ``(v, i)`` of the least non-null value, the earliest on ties."""
    value = F.col(val_col)
    return F.min(F.when(value.isNotNull() & ~F.isnan(value),
                        F.struct(value.alias("v"), F.col(iter_col).alias("i"))))


def _segments(log: DataFrame, limit: int, run: str, it: str, val: str) -> DataFrame:
    """One row per ``(run, bucket)``: how the evaluations of a segment change any earlier state.

    What happens in a segment depends on the state before it only until its first
    evaluation below the best so far; from there on the chain of its own new minima
    decides.  A segment therefore comes down to, at most ``limit`` entries each: its first
    rows (where a stop falls if nothing improves) and the new minima among them, each with
    the stop its chain leads to, if any.  Two such summaries compose to one.
    """
    w = Window.partitionBy(run, BUCKET).orderBy(it)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    value = F.col(val).cast("double")
    real = F.when(value.isNotNull() & ~F.isnan(value),
                  F.struct(value.alias("v"), F.col(it).alias("i")))
    rows = log.select(run, BUCKET, it, value.alias("_v"), real.alias("_real"),
                      (F.row_number().over(w) - 1).cast("long").alias("_pos"),
                      F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    lowest = F.coalesce(F.col("_before"), F.lit(float("inf")))
    rows = rows.withColumn("_new", F.coalesce(F.col("_v") < lowest, F.lit(False)))
    rows = rows.withColumns({
        "_low": F.min("_real").over(upto),
        "_next": F.min(F.when(F.col("_new"), F.col("_pos"))).over(later),
        "_stop": F.lead(it, limit).over(w)})
    ends = F.col("_new") & F.col("_stop").isNotNull() & (
        F.col("_next").isNull() | (F.col("_next") > F.col("_pos") + limit))
    chain = F.when(ends, F.struct(F.col("_pos").alias("pos"), F.col("_stop").alias("stop_iter"),
                                  F.col("_real").alias("low")))
    rows = rows.withColumn("_chain", F.min(chain).over(onward))
    first = F.col("_pos") < limit
    return rows.groupBy(run, BUCKET).agg(
        F.count(F.lit(1)).alias("n"), F.min("_real").alias("low"),
        F.max(F.when(F.col("_new"), F.col("_pos"))).alias("last_new"),
        F.sort_array(F.collect_list(F.when(first, F.struct(
            F.col("_pos").alias("pos"), F.col(it).alias("iter"), F.col("_low").alias("low")))))
        .alias("head"),
        F.sort_array(F.collect_list(F.when(first & F.col("_new"), F.struct(
            F.col("_pos").alias("pos"), F.col("_v").alias("v"), F.col("_chain").alias("chain")))))
        .alias("minima"))


def early_stop(log: DataFrame, limit: int, run_col: str = "run_id", iter_col: str = "iter",
               val_col: str = "val_loss", n_buckets: int | None = None) -> DataFrame:
    """Per run the stop iteration (first patience >= limit; none when limit = 0),
    evaluations run, and the best (earliest minimum) up to the stop.

    One pass: segments of iterations are summarised apart and a run's summaries
    (one per bucket) are folded in order, so there are two exchanges, however long a
    run is.  A ``_bucket`` column that is monotone in ``iter`` is reused.
    """
    if limit <= 0:
        return log.groupBy(run_col).agg(
            F.lit(None).cast("bigint").alias("stop_iter"),
            F.count(F.lit(1)).cast("bigint").alias("n_evals"),
            _earliest_minimum(val_col, iter_col).alias("_b")).select(
            run_col, "stop_iter", "n_evals", F.col("_b.v").alias("best_val"),
            F.col("_b.i").alias("best_iter"))
    dealt = log if BUCKET in log.columns else add_order_bucket(log, [iter_col], n_buckets)
    segments = _segments(dealt, limit, run_col, iter_col, val_col)
    iter_type = log.schema[iter_col].dataType
    low_type = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("i", iter_type)])
    start = F.struct(F.lit(INITIAL_BEST).alias("best"), F.lit(0).cast("long").alias("patience"),
                     F.lit(0).cast("long").alias("seen"), F.lit(None).cast(low_type).alias("low"),
                     F.lit(None).cast(iter_type).alias("stop_iter"), F.lit(False).alias("done"))

    def state(best, patience, seen, low, stop_iter, done):
        return F.struct(best.alias("best"), patience.cast("long").alias("patience"),
                        seen.cast("long").alias("seen"), low.alias("low"),
                        stop_iter.alias("stop_iter"), done.alias("done"))

    def through(s, g):
        room = (F.lit(limit) - s["patience"]).cast("int")  # rows without improvement to a stop
        first = F.get(F.filter(g["minima"], lambda m: m["v"] < s["best"]), F.lit(0))
        improves = F.coalesce(first["pos"] < room, F.lit(False))
        at = F.get(g["head"], room - 1)
        chain = first["chain"]
        no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast(iter_type)
        return F.when(s["done"], s).when(
            ~improves & (g["n"] >= room),
            state(s["best"], s["patience"], s["seen"] + room, F.least(s["low"], at["low"]),
                  at["iter"], yes)).when(
            ~improves, state(s["best"], s["patience"] + g["n"], s["seen"] + g["n"],
                             F.least(s["low"], g["low"]), none, no)).when(
            chain.isNotNull(),
            state(chain["low"]["v"], F.lit(limit), s["seen"] + chain["pos"] + limit + 1,
                  F.least(s["low"], chain["low"]), chain["stop_iter"], yes)).otherwise(
            state(g["low"]["v"], g["n"] - 1 - g["last_new"], s["seen"] + g["n"],
                  F.least(s["low"], g["low"]), none, no))

    parts = F.sort_array(F.collect_list(F.struct(
        F.col(BUCKET).alias("bucket"), "n", "low", "last_new", "head", "minima")))
    return (segments.groupBy(run_col).agg(parts.alias("_parts"))
            .select(run_col, F.aggregate("_parts", start, through).alias("_s"))
            .select(run_col, F.col("_s.stop_iter").alias("stop_iter"),
                    F.col("_s.seen").alias("n_evals"), F.col("_s.low.v").alias("best_val"),
                    F.col("_s.low.i").alias("best_iter")))


def checkpoints(marked: DataFrame, always_save: bool = False, run_col: str = "run_id",
                iter_col: str = "iter", val_col: str = "val_loss") -> DataFrame:
    """Saves happen at improvements when ``always_save or iter > 0``; the best is the
    earliest minimum; the final save (last iteration) is reported apart."""
    save = F.col("improved") & (F.lit(always_save) | (F.col(iter_col) > 0))
    best = _earliest_minimum(val_col, iter_col)
    return marked.groupBy(run_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_evals"),
        F.sum(F.col("improved").cast("int")).cast("bigint").alias("n_improvements"),
        F.sum(save.cast("int")).cast("bigint").alias("n_saves"),
        F.max(F.when(save, F.col(iter_col))).alias("last_save_iter"),
        F.max(iter_col).alias("final_iter"),
        best.alias("_b")).select(run_col, "n_evals", "n_improvements", "n_saves",
                                 "last_save_iter", "final_iter",
                                 F.col("_b.v").alias("best_val"), F.col("_b.i").alias("best_iter"))


def step_time(df: DataFrame, run_col: str = "run_id", order_cols: list[str] | None = None,
              ts_col: str = "ts", idx_col: str | None = None) -> DataFrame:
    """Seconds since the previous step of the run ended (NULL for the first)."""
    order = order_cols or ["iter"]
    if idx_col is None:
        df = row_index(df, [run_col], order, "_idx", keep_bucket=True)
        idx_col = "_idx"
    prev = with_previous(df, [run_col], [ts_col], idx_col)
    dt = F.timestamp_diff("MICROSECOND", F.col(f"{ts_col}_prev"), F.col(ts_col)) / 1e6
    out = prev.withColumn("dt", dt).drop(f"{ts_col}_prev", "_bucket")
    return out.drop("_idx") if idx_col == "_idx" else out


# Rows (or maps) composed in one group of the smoothed-value scan.
FOLD_GROUP = 64


def _through(items, start):
    """Value after the affine maps ``(a, c)`` of ``items`` in order, from ``start``."""
    return F.aggregate(items, start, lambda e, m: m["a"] * e + m["c"])


def ema(df: DataFrame, value_col: str, run_col: str = "run_id", pos_col: str = "pos",
        alpha: float = 0.1, out_col: str = "ema", group: int = FOLD_GROUP) -> DataFrame:
    """``e0 = x0; e = (1 - alpha) * e + alpha * x`` in ``pos`` order per run.

    ``pos`` is the dense 0-based position inside the run.  Every row is the affine
    map ``e -> (1 - alpha) e + alpha x``; ``group`` consecutive maps compose to one, and
    so on upwards until a run has a single map.  Going down again each group gets
    the exact value that enters it, so a row's value rests on its whole past and no
    group ever holds more than ``group`` maps, however long the run.
    """
    keep, x = F.lit(1.0 - alpha), F.col(value_col).cast("double")
    longest = df.agg(F.max(pos_col)).first()[0]
    depth, span = 1, group
    while longest is not None and longest >= span:
        depth, span = depth + 1, span * group
    level = df.select(F.col(run_col).alias("_run"), F.col(pos_col).alias("_at"),
                      keep.alias("a"), (F.lit(alpha) * x).alias("c"))
    groups = []
    for _ in range(depth):
        maps = F.sort_array(F.collect_list(F.struct("_at", "a", "c")))
        grouped = level.groupBy("_run", F.floor(F.col("_at") / group).alias("_up")).agg(
            maps.alias("_maps"))
        groups.append(grouped)
        level = grouped.select(
            "_run", F.col("_up").alias("_at"),
            F.aggregate("_maps", F.lit(1.0), lambda p, m: p * m["a"]).alias("a"),
            _through(F.col("_maps"), F.lit(0.0)).alias("c"))
    # the value entering the first map of a run is its first value
    entering = df.where(F.col(pos_col) == 0).select(
        F.col(run_col).alias("_run"), F.lit(0).cast("bigint").alias("_up"), x.alias("_in"))
    for grouped in reversed(groups):
        seen = F.transform("_maps", lambda m, i: F.struct(
            m["_at"].alias("_at"),
            _through(F.slice("_maps", F.lit(1), i), F.col("_in")).alias("_in"),
            m["a"].alias("a"), m["c"].alias("c")))
        entering = (grouped.join(entering, ["_run", "_up"])
                    .select("_run", F.explode(seen).alias("_m"))
                    .select("_run", F.col("_m._at").alias("_up"), F.col("_m._in").alias("_in"),
                            (F.col("_m.a") * F.col("_m._in") + F.col("_m.c")).alias("_e")))
    found = entering.select(F.col("_run").alias(run_col), F.col("_up").alias(pos_col),
                            F.col("_e").alias(out_col))
    return df.join(found, [run_col, pos_col], "left").select(*df.columns, out_col)


def step_loss(df: DataFrame, run_cols: list[str], loss_col: str = "loss") -> DataFrame:
    """Per iteration the micro-batch mean and the logged value (their sum, quirk Q9)."""
    return df.groupBy(*run_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_micro"),
        F.avg(loss_col).alias("mean_loss"),
        F.sum(loss_col).alias("logged_loss"))


# Buckets of a run log, and consecutive iterations of a run that share one.
LOG_BUCKETS, LOG_SPAN = 64, 4096
LOG_KEYS = {"eval": ["run_id", "iter"], "step": ["run_id", "iter", "micro"]}


def write_run_log(df: DataFrame, path: str, kind: str = "eval",
                  n_buckets: int = LOG_BUCKETS) -> None:
    """K6: schema-checked merge of eval or step records into a run-log table.

    The table keeps one record per run and iteration (and micro-batch of a step log); a
    record written again replaces the one before, so appending the same records twice
    changes nothing.  Records lie in ``n_buckets`` files by a hash of run and span of
    iterations, however many runs there are and however long one is.  A write rewrites the
    buckets it touches and publishes them as the next version; a failed or concurrent
    write leaves the version before.
    """
    schema = RUN_EVAL_SCHEMA if kind == "eval" else RUN_STEP_SCHEMA
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"run log ({kind}) lacks columns {missing}")
    spark = df.sparkSession
    version, now = latest(spark, path)
    buckets = now["n_buckets"] if now else n_buckets
    place = F.pmod(F.xxhash64("run_id", F.floor(F.col("iter") / LOG_SPAN)), F.lit(buckets))
    fresh = materialize(
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        .withColumn("bucket", place.cast("int")), "run-log")
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return
    files = dict(now["files"]) if now else {}
    stale = [files[str(b)] for b in touched if str(b) in files]
    both = fresh.withColumn("_new", F.lit(1))
    if stale:
        old = spark.read.schema(schema).parquet(*stale).withColumn("bucket", place.cast("int"))
        both = both.unionByName(old.withColumn("_new", F.lit(0)))
    keys = [*LOG_KEYS[kind], "bucket"]
    rest = [f.name for f in schema.fields if f.name not in keys]
    merged = both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("_r"))
    folder = f"{path.rstrip('/')}/data-{version + 1:010d}-{uuid.uuid4().hex[:8]}"
    (merged.select(*[F.col(f.name) if f.name in keys else F.col(f"_r.{f.name}")
                     for f in schema.fields], "bucket")
     .repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder))
    files |= {str(b): f"{folder}/bucket={b}" for b in touched}
    publish(spark, path, version + 1, {"kind": kind, "n_buckets": buckets, "files": files})
    remove(spark, stale)


def read_run_log(spark, path: str, kind: str = "eval") -> DataFrame:
    """The current version of a run log; a plain Parquet folder is read as it is."""
    schema = RUN_EVAL_SCHEMA if kind == "eval" else RUN_STEP_SCHEMA
    _, now = latest(spark, path)
    if now is None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).parquet(*sorted(now["files"].values()))
