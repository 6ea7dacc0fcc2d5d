"""Buckets, tasks, arrival files and micro-batches follow the measured size of the input."""

from pyspark.sql import functions as F

import quire.plans.corpus as corpus
import quire.streaming.ingest as ingest
from quire.plans.corpus import buckets_for, tokenized_corpus
from quire.plans.io_queries import PRIME, _stream_stats
from quire.streaming.ingest import arrival_files, file_stream, files_per_trigger, stage_in_order


def _docs(spark, n=400):
    return spark.range(n).select(F.col("id").alias("doc_id"),
                                 F.repeat(F.lit("ab "), (F.col("id") % 7).cast("int")).alias("text"))


def test_buckets_and_tasks_follow_the_tokens(spark, monkeypatch):
    docs = _docs(spark)
    want = {tuple(r) for r in tokenized_corpus(docs).select("doc_id", "split", "start").collect()}
    assert buckets_for(spark, corpus.BUCKET_TOKENS) is None
    monkeypatch.setattr(corpus, "BUCKET_TOKENS", 100)
    n = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    got = tokenized_corpus(docs)
    assert got.rdd.getNumPartitions() == buckets_for(spark, n) == -(-n // 100) > 8
    assert {tuple(r) for r in got.select("doc_id", "split", "start").collect()} == want


def test_budget_above_the_total_needs_no_scan(spark, monkeypatch):
    docs = _docs(spark, 50).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    kept = {b: {r.doc_id for r in tokenized_corpus(docs, max_tokens=b).select("doc_id").collect()}
            for b in (total, total - 8)}
    assert kept[total] == set(range(50)) and kept[total - 8] != kept[total]
    monkeypatch.setattr(corpus, "token_budget", None)
    assert {r.doc_id for r in tokenized_corpus(docs, max_tokens=total + 1).collect()} == kept[total]


def test_stream_stats(spark):
    rows = spark.createDataFrame([(0, [5, 7]), (PRIME - 1, [65535])], "offset long, tokens array<int>")
    want = ((5 + 1) + (7 + 1) * 2 + (65535 + 1) * (PRIME % PRIME)) % PRIME
    assert [tuple(r) for r in _stream_stats(rows, "val", 1, "lab_").collect()] == [("val", 3, 65547, want)]
    assert _stream_stats(rows.where("false"), "val").collect() == []


def test_arrival_files_by_the_rows_bytes(spark, monkeypatch, tmp_path):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 1000).alias("text"))
    docs.withColumns({f"c{i}": F.lit("") for i in range(20)}).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(ingest, "ARRIVAL_BYTES", 4096)
    n = arrival_files(spark.read.parquet(f"{tmp_path}/docs").select("doc_id", "text"))
    assert n == -(-64 * 1008 // 4096)
    assert arrival_files(docs.limit(0)) == ingest.LEAST_FILES


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    assert [files_per_trigger(spark, n) for n in (4, 7, 8, 10_000)] == [1, 1, min(2, cores), cores]
    log = spark.range(1000).select(F.col("id").alias("iter"))
    stage_in_order(log, "iter", 8, f"{tmp_path}/in")
    seen = []
    q = (file_stream(spark, f"{tmp_path}/in", log.schema, files_per_trigger(spark, 8)).writeStream
         .foreachBatch(lambda b, i: seen.append(tuple(b.agg(F.min("iter"), F.max("iter")).first())))
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 4 and seen == sorted(seen)
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
