"""ST1/ST2: streaming corpus ingest and a token budget across micro-batches.

ST1 is stateless: ``readStream`` (file source) -> tokenize -> split -> append
to a parquet sink; ``trigger(availableNow=True)`` drains what is there and
stops.  ST2 keeps one global running total in a *ledger* table: for micro-batch
``b`` the base is the sum of the ledger rows of batches ``< b``; the batch's own
prefix sum is added, rows with ``base + start < max`` are kept, and both the
output and the ledger row are written to the ``batch_id=b`` partition with
dynamic overwrite, so replaying a batch after a failure is idempotent.  The output
holds the tokens of every kept document.  Once the ledger total reaches the budget,
the query is stopped; a batch that had begun by then returns without running a job.
"""

from __future__ import annotations

import os
import time

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.scan import prefix_aggregate
from quire.operators.split import assign_split
from quire.operators.tokenize import Tokenizer, token_count, tokenize
from quire.session import ship_package

# Bytes of the rows (not of their Parquet) per staged arrival file, and the fewest files, so that
# small inputs still make several micro-batches.
ARRIVAL_BYTES = 32 << 20
LEAST_FILES = 4
# Seconds between two looks at the ledger of a running query.
STOP_POLL = 0.2


def arrival_files(df: DataFrame) -> int:
    """Files to stage ``df`` in, by the measured size of its rows.

    The optimizer's size would not do: it takes every column of a file as equally wide.
    """
    width = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f.name)
        n = F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) \
            else F.size(c) * 8 if isinstance(f.dataType, T.ArrayType) else F.lit(8)
        width = width + F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    total = df.agg(F.sum(width)).first()[0] or 0
    return max(LEAST_FILES, -(-int(total) // ARRIVAL_BYTES))


def files_per_trigger(spark: SparkSession, n_files: int) -> int:
    """Files of a micro-batch: a file a core, but at least ``LEAST_FILES`` micro-batches in all.

    With a file at a time the micro-batches would be as many as the files and use one
    core each, and state that all of them touch would be read and written once a file.
    """
    return max(1, min(n_files // LEAST_FILES, spark.sparkContext.defaultParallelism))


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None):
    """A file-source stream over a directory, or over one file via a glob + basePath."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if path.endswith(".parquet") and not os.path.isdir(path.replace("file:", "")):
        base = os.path.dirname(path)
        return r.option("basePath", base).parquet(path[:-1] + "[t]")
    return r.parquet(path)


PROGRESS = "tokens"


def observe_stream(stream: DataFrame, len_col: str = "n_tokens", name: str = PROGRESS) -> DataFrame:
    """K5: let every micro-batch of ``stream`` report its rows and tokens."""
    return stream.observe(name, F.count(F.lit(1)).alias("n_rows"),
                          F.sum(F.col(len_col).cast("bigint")).alias("n_tokens"))


class LiveCounter:
    """K5: rows and tokens so far of a running query, from its own progress reports.

    A report belongs to a micro-batch, so one that is seen twice or replayed counts once.
    """

    def __init__(self, query, name: str = PROGRESS):
        self.query, self.name = query, name
        self.batches: dict[int, tuple[int, int]] = {}

    def poll(self) -> tuple[int, int]:
        """``(n_rows, n_tokens)`` of the micro-batches reported up to now."""
        for p in self.query.recentProgress:
            seen = p.observedMetrics.get(self.name)
            if seen is not None:
                self.batches[p.batchId] = (seen["n_rows"] or 0, seen["n_tokens"] or 0)
        return tuple(sum(x) for x in zip(*self.batches.values())) or (0, 0)

    def follow(self, report=None, every: float = STOP_POLL) -> tuple[int, int]:
        """Poll until the query ends; ``report(n_rows, n_tokens)`` whenever they have grown."""
        last, ended = (0, 0), False
        while not ended:
            ended = bool(self.query.awaitTermination(every))
            now = self.poll()
            if now != last and report is not None:
                report(*now)
            last = now
        return last


def stream_tokenize(stream: DataFrame, out_path: str, checkpoint: str,
                    tokenizer: Tokenizer | None = None, id_col: str = "doc_id",
                    text_col: str = "text"):
    """ST1: tokenize + split every arriving document into a parquet sink; returns the query."""
    ship_package(stream.sparkSession)
    toks = assign_split(tokenize(stream.select(id_col, text_col), text_col, tokenizer), id_col)
    counted = observe_stream(toks.select(id_col, "split", "n_tokens", "tokens"))
    return (counted.writeStream.format("parquet")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


class BudgetLedger:
    """The ST2 ``foreachBatch`` function; ledger and output live in shared storage."""

    def __init__(self, out_path: str, ledger_path: str, max_tokens: int,
                 order_by: str = "doc_id", tokenizer: Tokenizer | None = None,
                 text_col: str = "text"):
        self.out_path, self.ledger_path = out_path, ledger_path
        self.max_tokens, self.order_by = max_tokens, order_by
        self.tokenizer, self.text_col = tokenizer, text_col
        self.reached = False
        self.reached_at = None

    def _base(self, spark, batch_id: int) -> int:
        try:
            led = spark.read.parquet(self.ledger_path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # nothing ingested yet
                return 0
            raise
        v = led.where(F.col("batch_id") < batch_id).agg(F.sum("n_tokens")).first()[0]
        return int(v or 0)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.reached and batch_id > self.reached_at:
            return
        spark = batch.sparkSession
        base = self._base(spark, batch_id)
        if base >= self.max_tokens and base > 0:
            self.reached_at, self.reached = batch_id, True
            return
        docs = assign_split(batch.select(self.order_by, self.text_col), self.order_by)
        # the source is read and measured once; splitters, offsets, texts and total use that
        docs = docs.select(self.order_by, "split",
                           token_count(F.col(self.text_col), self.tokenizer).cast("bigint")
                           .alias("n_tokens"), self.text_col).persist(StorageLevel.DISK_ONLY)
        try:
            total = docs.agg(F.sum("n_tokens")).first()[0] or 0
            self._write(docs, spark, batch_id, base, int(total))
        finally:
            docs.unpersist()
        if base + total >= self.max_tokens:
            self.reached_at, self.reached = batch_id, True

    def _write(self, docs: DataFrame, spark, batch_id: int, base: int, total: int) -> None:
        """The batch's kept documents, then its line of the ledger."""
        local = prefix_aggregate(docs, [self.order_by], {"_start": ("sum", F.col("n_tokens"))})
        kept = local.withColumn("budget_start", F.col("_start") + F.lit(base)).drop("_start")
        kept = kept.where((F.col("budget_start") < self.max_tokens) | (F.col("budget_start") == 0))
        kept = tokenize(kept, self.text_col, self.tokenizer, len_col=None).drop(self.text_col)
        kept = kept.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(self.out_path)
        spark.createDataFrame([(batch_id, total)], "batch_id bigint, n_tokens bigint") \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(self.ledger_path)


def stream_budget(stream: DataFrame, max_tokens: int, out_path: str, ledger_path: str,
                  checkpoint: str, order_by: str = "doc_id",
                  tokenizer: Tokenizer | None = None) -> BudgetLedger:
    """ST2: run the budgeted ingest to completion (or until the budget is reached)."""
    ship_package(stream.sparkSession)
    ledger = BudgetLedger(out_path, ledger_path, max_tokens, order_by, tokenizer)
    q = (stream.writeStream.foreachBatch(ledger).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    # a batch interrupted by the stop is replayed by the next run over this checkpoint
    while not q.awaitTermination(STOP_POLL):
        if ledger.reached:
            q.stop()
    if q.exception() is not None:
        raise q.exception()
    return ledger


def stage_in_order(df: DataFrame, order_col: str, n_files: int, path: str) -> str:
    """Write ``df`` as ``n_files`` parquet files that arrive in ``order_col`` order.

    One parallel job range-partitions the rows (``repartitionByRange``), so part
    ``i`` holds the ``i``-th key range; then the parts' modification times are
    set in part order (``os.utime`` locally, the Hadoop FileSystem API on shared
    storage; metadata only).  The
    file source takes files oldest first, so any ``maxFilesPerTrigger`` turns
    into micro-batches that are contiguous key ranges, in key order.
    """
    spark = df.sparkSession
    (df.repartitionByRange(n_files, order_col).sortWithinPartitions(order_col)
     .write.mode("overwrite").parquet(path))
    t0 = time.time() - (n_files + 1)
    if path.startswith("file:") or "://" not in path:
        from urllib.parse import urlparse

        root = urlparse(path).path if path.startswith("file:") else path
        parts = sorted(f for f in os.listdir(root) if f.startswith("part-"))
        for i, name in enumerate(parts):
            os.utime(os.path.join(root, name), (t0 + i, t0 + i))
    else:  # shared storage: the Hadoop FileSystem API of the session
        jvm = spark.sparkContext._jvm
        hroot = jvm.org.apache.hadoop.fs.Path(path)
        fs = hroot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        parts = sorted((st.getPath() for st in fs.listStatus(hroot)
                        if st.getPath().getName().startswith("part-")), key=lambda q: q.getName())
        for i, part in enumerate(parts):
            fs.setTimes(part, int((t0 + i) * 1000), -1)
    return path
