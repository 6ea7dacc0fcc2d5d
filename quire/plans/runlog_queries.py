"""Driver queries for run-log analysis (stand-in: ``events`` as an eval/step log).

run = ``user_id``, iter = position of the event in its run by ``(ts, event_id)``,
val_loss = ``value``.  ``lineitem`` stands in for micro-batch losses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.schedule import gpt_param_count, lr_at, mfu
from quire.operators.neighbors import row_index
from quire.operators.report import gpt_manifest, observe_tokens, param_summary, run_plan
from quire.operators.runlog import (at_interval, cap_iterations, checkpoints, early_stop, ema,
                                    mark_improvements, read_run_log, step_loss, step_time,
                                    write_run_log)
from quire.operators.tokenize import tokenize
from quire.plans.corpus_queries import DOCS_CTE
from quire.plans.registry import query, table
from quire.session import scratch_path

PATIENCE = 5
EVAL_INTERVAL = 10
CAP = 50
LOG_INTERVAL = 10
# The two shipped run configurations (pre-train, SFT) and a short
# schedule that reaches the constant tail.
PRETRAIN = dict(learning_rate=6e-4, min_lr=6e-5, warmup_iters=2000, lr_decay_iters=20000,
                decay_lr=True, batch_size=4, block_size=512, grad_accum=48, max_iters=20000,
                n_layer=12, n_head=12, n_embd=768)
SFT = dict(learning_rate=5e-5, min_lr=5e-5, warmup_iters=100, lr_decay_iters=7002,
           decay_lr=False, batch_size=4, block_size=512, grad_accum=16, max_iters=7002)
SHORT = dict(learning_rate=6e-4, min_lr=6e-5, warmup_iters=100, lr_decay_iters=5000, decay_lr=True)
VOCAB = 50304

RUNS_CTE = """
r AS (
  SELECT user_id AS run_id, ts, value AS val_loss,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter
  FROM events),
i AS (
  SELECT *, val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY iter
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS improved
  FROM r)"""


def _runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("val_loss"))
    return row_index(ev, ["run_id"], ["ts", "event_id"], "iter", keep_bucket=True).drop("event_id")


def _lr_sql(cfg):
    it, w, d, lr, mn = "iter", cfg["warmup_iters"], cfg["lr_decay_iters"], cfg["learning_rate"], cfg["min_lr"]
    if not cfg["decay_lr"]:
        return f"CAST({lr} AS DOUBLE)"
    return (f"CASE WHEN {it} < {w} THEN {lr} * ({it} + 1) / greatest(1, {w} + 1)::DOUBLE "
            f"WHEN {it} > {d} THEN {mn} "
            f"ELSE {mn} + 0.5 * (1.0 + cos(pi() * least(greatest(({it} - {w}) / "
            f"greatest(1, {d} - {w})::DOUBLE, 0.0), 1.0))) * ({lr} - {mn}) END")


@query("lr_schedule", oracle=f"""
SELECT iter, round({_lr_sql(PRETRAIN)}, 15) AS lr_pretrain, round({_lr_sql(SFT)}, 15) AS lr_sft,
       round({_lr_sql(SHORT)}, 15) AS lr_short
FROM (SELECT event_id AS iter FROM events)""")
def q_lr_schedule(spark, sf_dir):
    """Learning rate at every logged iteration (event_id) under three schedules."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("iter"))

    def lr(c):
        return F.round(lr_at("iter", c["warmup_iters"], c["lr_decay_iters"], c["learning_rate"],
                             c["min_lr"], c["decay_lr"]), 15)

    return ev.select("iter", lr(PRETRAIN).alias("lr_pretrain"), lr(SFT).alias("lr_sft"),
                     lr(SHORT).alias("lr_short"))


@query("early_stop", oracle=f"""
WITH {RUNS_CTE.strip()},
p AS (
  SELECT *, CASE WHEN li IS NULL THEN iter + 1 ELSE iter - li END AS patience
  FROM (SELECT *, max(CASE WHEN improved THEN iter END) OVER (PARTITION BY run_id ORDER BY iter
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM i)),
s AS (SELECT run_id, min(CASE WHEN patience >= {PATIENCE} THEN iter END) AS stop_iter
      FROM p GROUP BY run_id),
u AS (SELECT p.*, s.stop_iter FROM p JOIN s USING (run_id)
      WHERE s.stop_iter IS NULL OR p.iter <= s.stop_iter),
b AS (SELECT run_id, min(val_loss) AS best_val FROM u GROUP BY run_id)
SELECT u.run_id, any_value(u.stop_iter)::BIGINT AS stop_iter, count(*)::BIGINT AS n_evals,
       any_value(b.best_val) AS best_val,
       min(CASE WHEN u.val_loss = b.best_val THEN u.iter END)::BIGINT AS best_iter
FROM u JOIN b USING (run_id) GROUP BY u.run_id""")
def q_early_stop(spark, sf_dir):
    """Stop at the first evaluation with patience >= 5; best up to the stop."""
    return early_stop(_runs(spark, sf_dir), PATIENCE)


@query("best_checkpoint", oracle=f"""
WITH {RUNS_CTE.strip()},
b AS (SELECT run_id, min(val_loss) AS best_val FROM i GROUP BY run_id)
SELECT i.run_id, count(*)::BIGINT AS n_evals,
       sum(CASE WHEN improved THEN 1 ELSE 0 END)::BIGINT AS n_improvements,
       sum(CASE WHEN improved AND iter > 0 THEN 1 ELSE 0 END)::BIGINT AS n_saves,
       max(CASE WHEN improved AND iter > 0 THEN iter END)::BIGINT AS last_save_iter,
       max(iter)::BIGINT AS final_iter, any_value(b.best_val) AS best_val,
       min(CASE WHEN val_loss = b.best_val THEN iter END)::BIGINT AS best_iter
FROM i JOIN b USING (run_id) GROUP BY i.run_id""")
def q_best_checkpoint(spark, sf_dir):
    """Improvements, checkpoint saves (not at iteration 0), best and final iteration."""
    return checkpoints(mark_improvements(_runs(spark, sf_dir)), always_save=False)


@query("step_time", oracle="""
SELECT run_id, iter,
       (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY iter))) / 1e6 AS dt
FROM (SELECT user_id AS run_id, ts,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter
      FROM events)""")
def q_step_time(spark, sf_dir):
    """Seconds between consecutive steps of a run."""
    return step_time(_runs(spark, sf_dir), idx_col="iter").select("run_id", "iter", "dt")


def _mfu_n_params():
    c = PRETRAIN
    return gpt_param_count(VOCAB, c["block_size"], c["n_layer"], c["n_embd"], False, True)


@query("mfu", oracle=f"""
WITH s AS (
  SELECT run_id, iter,
         (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY iter))) / 1e6 AS dt
  FROM (SELECT user_id AS run_id, ts,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter
        FROM events)),
n AS (SELECT ({VOCAB} * 768 + 12 * (12 * 768 * 768 + 2 * 768) + 768)::DOUBLE AS n_params)
SELECT run_id, iter,
       CASE WHEN iter < 5 OR dt IS NULL THEN NULL
            ELSE round((6 * n_params + 12 * 12 * 12 * 64 * 512) * 512 * {4 * 48} / nullif(dt, 0) / 312e12, 12)
       END AS mfu
FROM s, n""")
def q_mfu(spark, sf_dir):
    """Model FLOPs utilisation of each step (none for the first 5 local steps)."""
    c = PRETRAIN
    st = step_time(_runs(spark, sf_dir), idx_col="iter")
    m = mfu(_mfu_n_params(), c["n_layer"], c["n_head"], c["n_embd"], c["block_size"],
            c["batch_size"] * c["grad_accum"], F.col("dt"))
    val = F.when((F.col("iter") < 5) | F.col("dt").isNull(), F.lit(None).cast("double")) \
        .otherwise(F.round(m, 12))
    return st.select("run_id", "iter", val.alias("mfu"))


@query("ema", oracle=f"""
WITH r AS (
  SELECT user_id AS run_id, value / 100.0 AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter
  FROM events),
l AS (SELECT * FROM r WHERE iter % {LOG_INTERVAL} = 0 AND iter >= 5)
SELECT run_id, iter,
       round(list_reduce(list(x) OVER (PARTITION BY run_id ORDER BY iter
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         lambda e, v: 0.9 * e + 0.1 * v), 9) AS running_mfu
FROM l""")
def q_ema(spark, sf_dir):
    """Smoothed MFU over logged steps (every 10th, after 5 local steps)."""
    runs = _runs(spark, sf_dir).withColumn("x", F.col("val_loss") / 100.0)
    logged = runs.where((F.col("iter") % LOG_INTERVAL == 0) & (F.col("iter") >= 5))
    logged = logged.withColumn("pos", (F.floor(F.col("iter") / LOG_INTERVAL) - 1).cast("bigint"))
    out = ema(logged, "x", pos_col="pos", alpha=0.1, out_col="running_mfu")
    return out.select("run_id", "iter", F.round("running_mfu", 9).alias("running_mfu"))


EMA_EVERY = 97


def _smoothed_events(spark, sf_dir):
    """``(iter, smoothed)`` of every event, all taken as one run."""
    ev = table(spark, sf_dir, "events").select(
        F.lit(0).cast("bigint").alias("run_id"), "ts", "event_id", (F.col("value") / 100.0).alias("x"))
    run = row_index(ev, ["run_id"], ["ts", "event_id"], "pos", keep_bucket=True).select(
        "run_id", "pos", "x")
    out = ema(run, "x", alpha=0.1, out_col="smoothed")
    return out.select(F.col("pos").alias("iter"), F.round("smoothed", 9).alias("smoothed"))


@query("ema_long", oracle=f"""
WITH r AS (
  SELECT value / 100.0 AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS iter FROM events),
l AS (SELECT list(x ORDER BY iter) AS xs FROM r)
SELECT iter, round(list_reduce(xs[1:iter + 1], lambda e, v: 0.9 * e + 0.1 * v), 9) AS smoothed
FROM r, l WHERE iter % {EMA_EVERY} = 0""")
def q_ema_long(spark, sf_dir):
    """R6 over one run that holds every event: the value is carried over its whole length."""
    return _smoothed_events(spark, sf_dir).where(F.col("iter") % EMA_EVERY == 0)


# Rows that the oracle below folds in one piece; not a multiple of FOLD_GROUP.
EMA_PIECE = 250


@query("ema_every_row", oracle=f"""
WITH RECURSIVE r AS (
  SELECT value / 100.0 AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS iter FROM events),
p AS (SELECT iter // {EMA_PIECE} AS piece, list(x ORDER BY iter) AS xs FROM r GROUP BY piece),
n AS (
  SELECT piece, xs[1] AS entering FROM p WHERE piece = 0
  UNION ALL
  SELECT n.piece + 1, list_reduce([n.entering] || p.xs, lambda e, v: 0.9 * e + 0.1 * v)
  FROM n JOIN p ON p.piece = n.piece)
SELECT iter, round(list_reduce([entering] || xs[1:iter % {EMA_PIECE} + 1],
                               lambda e, v: 0.9 * e + 0.1 * v), 9) AS smoothed
FROM r JOIN p ON p.piece = iter // {EMA_PIECE} JOIN n ON n.piece = p.piece""")
def q_ema_every_row(spark, sf_dir):
    """R6 over one run that holds every event: the smoothed value of each of its rows."""
    return _smoothed_events(spark, sf_dir)


@query("at_interval", oracle=f"""
SELECT run_id, iter, val_loss FROM (
  SELECT user_id AS run_id, value AS val_loss,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter
  FROM events)
WHERE iter % {EVAL_INTERVAL} = 0 AND iter <= {CAP}""")
def q_at_interval(spark, sf_dir):
    """Evaluation rows every 10 iterations, up to and including iteration 50."""
    r = _runs(spark, sf_dir)
    return cap_iterations(at_interval(r, EVAL_INTERVAL), CAP).select("run_id", "iter", "val_loss")


@query("step_loss", oracle="""
SELECT l_orderkey AS iter, count(*)::BIGINT AS n_micro, round(avg(l_quantity), 9) AS mean_loss,
       round(sum(l_quantity), 9) AS logged_loss
FROM lineitem GROUP BY l_orderkey""")
def q_step_loss(spark, sf_dir):
    """Micro-batch mean and logged (summed) loss per iteration."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("iter"), F.col("l_quantity").alias("loss"))
    out = step_loss(li, ["iter"])
    return out.select("iter", "n_micro", F.round("mean_loss", 9).alias("mean_loss"),
                      F.round("logged_loss", 9).alias("logged_loss"))


@query("run_plan", oracle=f"""
WITH {DOCS_CTE.strip()},
c AS (SELECT * FROM (VALUES ('pretrain', 4, 512, 48, 1, 20000), ('sft', 4, 512, 16, 1, 7002))
      v(config, batch_size, block_size, grad_accum, world_size, max_iters)),
n AS (SELECT sum(n_tokens)::BIGINT AS corpus_tokens FROM d WHERE split = 'train')
SELECT config, (grad_accum // world_size * world_size * batch_size * block_size)::BIGINT AS tokens_per_iter,
       (max_iters + 1)::BIGINT AS iters_run,
       ((grad_accum // world_size * world_size * batch_size * block_size) * (max_iters + 1))::BIGINT
         AS tokens_sampled,
       corpus_tokens,
       round((grad_accum // world_size * world_size * batch_size * block_size) * (max_iters + 1)
             / corpus_tokens::DOUBLE, 6) AS epochs
FROM c, n""")
def q_run_plan(spark, sf_dir):
    """Tokens per iteration, iterations run and epochs over the train corpus."""
    from quire.operators.split import assign_split
    from quire.operators.tokenize import token_count

    cfg = spark.createDataFrame(
        [("pretrain", 4, 512, 48, 1, 20000), ("sft", 4, 512, 16, 1, 7002)],
        "config string, batch_size int, block_size int, grad_accum int, world_size int, max_iters int")
    docs = assign_split(table(spark, sf_dir, "documents").select("doc_id", "text"))
    train = docs.where(F.col("split") == "train").agg(
        F.sum(token_count(F.col("text")).cast("bigint")).alias("n_tokens"))
    out = run_plan(cfg, train)
    return out.select("config", "tokens_per_iter", "iters_run", "tokens_sampled",
                      "corpus_tokens", "epochs")


@query("run_plan_workers", oracle=f"""
WITH {DOCS_CTE.strip()},
n AS (SELECT sum(n_tokens)::BIGINT AS corpus_tokens FROM d WHERE split = 'train')
SELECT w::INTEGER AS world_size, (16 // w * w * 4 * 512)::BIGINT AS tokens_per_iter,
       ((16 // w * w * 4 * 512) * 7003)::BIGINT AS tokens_sampled, corpus_tokens
FROM n, (VALUES (1), (4), (8)) v(w)""")
def q_run_plan_workers(spark, sf_dir):
    """The accumulation is shared out among 1, 4 and 8 workers."""
    from quire.operators.split import assign_split
    from quire.operators.tokenize import token_count

    cfg = spark.createDataFrame(
        [(4, 512, 16, w, 7002) for w in (1, 4, 8)],
        "batch_size int, block_size int, grad_accum int, world_size int, max_iters int")
    docs = assign_split(table(spark, sf_dir, "documents").select("doc_id", "text"))
    train = docs.where(F.col("split") == "train").agg(
        F.sum(token_count(F.col("text")).cast("bigint")).alias("n_tokens"))
    return run_plan(cfg, train).select("world_size", "tokens_per_iter", "tokens_sampled",
                                       "corpus_tokens")


@query("run_log_sink", oracle="""
SELECT user_id AS run_id, count(*)::BIGINT AS n_evals, round(sum(value), 6) AS loss_sum,
       min(value) AS best_val
FROM events GROUP BY user_id""")
def q_run_log_sink(spark, sf_dir):
    """K6: evaluations appended to a run-log table in two writes, read back per run."""
    log = _runs(spark, sf_dir).select(
        "run_id", "iter", F.lit(None).cast("double").alias("train_loss"), "val_loss",
        F.lit(None).cast("double").alias("lr"), F.lit(None).cast("double").alias("mfu"))
    path = scratch_path(spark, "run-log")
    for half in (0, 1):
        write_run_log(log.where(F.col("iter") % 2 == half), path)
    return read_run_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_evals"),
        F.round(F.sum("val_loss"), 6).alias("loss_sum"), F.min("val_loss").alias("best_val"))


@query("run_log_merged", oracle="""
WITH r AS (
  SELECT user_id AS run_id, value AS val_loss,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter FROM events)
SELECT run_id, count(*)::BIGINT AS n_evals,
       round(sum(CASE WHEN iter % 3 = 0 THEN val_loss + 1 ELSE val_loss END), 6) AS loss_sum,
       round(min(CASE WHEN iter % 3 = 0 THEN val_loss + 1 ELSE val_loss END), 9) AS best_val
FROM r GROUP BY run_id""")
def q_run_log_merged(spark, sf_dir):
    """K6: a log written twice, then every third evaluation again with another loss."""
    log = _runs(spark, sf_dir).select(
        "run_id", "iter", F.lit(None).cast("double").alias("train_loss"), "val_loss",
        F.lit(None).cast("double").alias("lr"), F.lit(None).cast("double").alias("mfu"))
    path = scratch_path(spark, "run-log-merged")
    for part in (log, log, log.where("iter % 3 = 0").withColumn("val_loss", F.col("val_loss") + 1)):
        write_run_log(part, path)
    return read_run_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_evals"),
        F.round(F.sum("val_loss"), 6).alias("loss_sum"),
        F.round(F.min("val_loss"), 9).alias("best_val"))


@query("observed_tokens", oracle=f"""
WITH {DOCS_CTE.strip()}
SELECT count(*)::BIGINT AS n_rows, sum(n_tokens)::BIGINT AS n_tokens FROM d""")
def q_observed_tokens(spark, sf_dir):
    """K5: what the progress counter shows after the corpus has been written once."""
    from quire.operators.tokenize import token_count

    docs = table(spark, sf_dir, "documents").select(token_count(F.col("text")).alias("n_tokens"))
    observed, counter = observe_tokens(docs)
    observed.write.format("noop").mode("overwrite").save()
    seen = counter.get
    return spark.createDataFrame([(seen["n_rows"], seen["n_tokens"])], "n_rows long, n_tokens long")


@query("param_summary", oracle="""
WITH v AS (
  SELECT (ceil((max(t) + 1) / 64.0) * 64)::BIGINT AS vocab
  FROM (SELECT greatest(256, list_max(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                                     lambda x: ('0x' || x)::INTEGER))) AS t
        FROM documents))
SELECT 1::BIGINT AS run_id,
       (vocab * 768 + 512 * 768 + 12 * (12 * 768 * 768 + 2 * 768) + 768)::BIGINT AS n_params,
       (vocab * 768 + 12 * (12 * 768 * 768 + 2 * 768) + 768)::BIGINT AS n_params_non_embedding,
       (2 + 4 * 12)::BIGINT AS n_decay_tensors,
       (vocab * 768 + 512 * 768 + 12 * 12 * 768 * 768)::BIGINT AS n_decay_params,
       (2 * 12 + 1)::BIGINT AS n_nodecay_tensors,
       ((2 * 12 + 1) * 768)::BIGINT AS n_nodecay_params
FROM v""")
def q_param_summary(spark, sf_dir):
    """Parameter counts of a 12x768 model sized to the corpus vocabulary (ids + eot, /64)."""
    toks = tokenize(table(spark, sf_dir, "documents").select("text"))
    vocab = toks.select((F.ceil((F.max(F.array_max("tokens")) + 1) / 64.0) * 64).cast("int")).scalar()
    manifest = gpt_manifest(spark, 1, vocab, 512, 12, 768, bias=False)
    return param_summary(manifest)
