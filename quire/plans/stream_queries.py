"""Driver queries that run Structured Streaming jobs to completion and read their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.arrays import array_sum
from quire.operators.report import corpus_report
from quire.plans.corpus_queries import BUDGET
from quire.plans.registry import ORACLES, query, table
from quire.plans.runlog_queries import PATIENCE, _runs
from quire.session import materialize, scratch_path, ship_package
from quire.streaming.early_stop import stream_early_stop
from quire.plans.io_queries import SPLITS, _stream_stats
from quire.sources.tokenbin import read_token_stream
from quire.streaming.ingest import LiveCounter, arrival_files, file_stream, files_per_trigger, \
    stage_in_order, stream_budget, stream_tokenize
from quire.streaming.token_files import stream_token_files

# Fixed value: iterations between two evaluations.
EVAL_EVERY = 200


def _docs_schema(spark, sf_dir):
    return table(spark, sf_dir, "documents").schema


def _arrivals(df, order_col, root):
    """``df`` staged as files that arrive in ``order_col`` order, some of them a micro-batch."""
    spark, n = df.sparkSession, arrival_files(df)
    stage_in_order(df, order_col, n, f"{root}/arrivals")
    return file_stream(spark, f"{root}/arrivals", df.schema, files_per_trigger(spark, n))


@query("stream_tokenize", oracle=ORACLES["corpus_report"])
def q_stream_tokenize(spark, sf_dir):
    """S1 ST1: documents as a file stream -> tokens + split in a parquet sink -> report."""
    ship_package(spark)
    root = scratch_path(spark, "st1")
    src = file_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", _docs_schema(spark, sf_dir))
    q = stream_tokenize(src, f"{root}/out", f"{root}/_checkpoint")
    q.awaitTermination()
    toks = spark.read.parquet(f"{root}/out")
    rep = corpus_report(toks, extra={"token_sum": F.sum(array_sum("tokens"))})
    return rep.select(
        "split", F.col("n_docs").cast("bigint").alias("n_docs"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("token_sum").cast("bigint").alias("token_sum"), "gib",
        F.col("total_tokens").cast("bigint").alias("total_tokens"))


@query("stream_budget", oracle=ORACLES["token_budget"])
def q_stream_budget(spark, sf_dir):
    """ST2: the 1,000,000-token budget kept across micro-batches by a ledger."""
    ship_package(spark)
    root = scratch_path(spark, "st2")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src = _arrivals(docs, "doc_id", root)
    stream_budget(src, BUDGET, f"{root}/out", f"{root}/ledger", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out").select("doc_id", "split", "n_tokens", "budget_start")


def _stream_stops(spark, log, root):
    """Arrivals of ``log(run_id, iter, val_loss)`` in iteration order -> latest summary per run."""
    src = _arrivals(materialize(log, "log"), "iter", root)
    summary = stream_early_stop(src, PATIENCE)

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite") \
            .parquet(f"{root}/out/batch_id={batch_id}")

    q = (summary.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    latest = out.groupBy("run_id").agg(F.max_by(F.struct(
        "stop_iter", "n_evals", "best_val", "best_iter", "n_late"), F.col("n_seen")).alias("s"))
    return latest.select("run_id", "s.stop_iter", "s.n_evals", "s.best_val", "s.best_iter",
                         "s.n_late")


@query("stream_early_stop", oracle=ORACLES["early_stop"])
def q_stream_early_stop(spark, sf_dir):
    """ST3: evaluations arriving in iteration order; per-run early stop in streaming state."""
    ship_package(spark)
    runs = _runs(spark, sf_dir).select("run_id", "iter", "val_loss")
    return _stream_stops(spark, runs, scratch_path(spark, "st3")).drop("n_late")


@query("stream_early_stop_sparse", oracle=f"""
SELECT run_id, stop_iter * {EVAL_EVERY} AS stop_iter, n_evals, best_val,
       best_iter * {EVAL_EVERY} AS best_iter FROM ({ORACLES["early_stop"]})""")
def q_stream_early_stop_sparse(spark, sf_dir):
    """ST3 on a log evaluated every 200 iterations; iterations, not positions, are reported."""
    ship_package(spark)
    runs = _runs(spark, sf_dir).select(
        "run_id", (F.col("iter") * EVAL_EVERY).alias("iter"), "val_loss")
    return _stream_stops(spark, runs, scratch_path(spark, "st3s")).drop("n_late")


@query("stream_progress", oracle=ORACLES["observed_tokens"])
def q_stream_progress(spark, sf_dir):
    """K5 ST1: what the live counter of a running ingest shows when the stream has ended."""
    ship_package(spark)
    root = scratch_path(spark, "k5")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src = _arrivals(docs, "doc_id", root)
    seen = LiveCounter(stream_tokenize(src, f"{root}/out", f"{root}/_checkpoint")).follow()
    return spark.createDataFrame([seen], "n_rows long, n_tokens long")


@query("stream_token_files", oracle=ORACLES["tokenbin_roundtrip"])
def q_stream_token_files(spark, sf_dir):
    """ST1 K1 S3: documents arriving in id order, written epoch by epoch into token files."""
    ship_package(spark)
    root = scratch_path(spark, "st1k1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src = _arrivals(docs, "doc_id", root)
    stream_token_files(src, f"{root}/tokens", f"{root}/_checkpoint").awaitTermination()
    out = None
    for split in SPLITS:
        s = _stream_stats(read_token_stream(spark, f"{root}/tokens/{split}"), split)
        out = s if out is None else out.unionByName(s)
    return out
