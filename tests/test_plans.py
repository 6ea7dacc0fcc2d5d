"""Plan shape: row-level windows are bucketed, scans are pruned, bounded sides broadcast."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from quire.operators.offsets import stream_offsets, token_budget
from quire.operators.sample import sample_windows


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _docs(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.range(500).selectExpr("id AS doc_id", "repeat('ab', cast(id % 13 + 1 AS int)) AS text",
                                "'x' AS lang").write.parquet(path)
    return spark.read.parquet(path)


def test_offsets_window_is_partitioned_by_bucket(spark, tmp_path):
    docs = _docs(spark, tmp_path).select("doc_id", F.lit("train").alias("split"),
                                         (F.octet_length("text") + 1).alias("n_tokens"))
    plan = _plan(stream_offsets(docs, "doc_id", n_buckets=4))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    row_level = [s for s in specs if "doc_id" in s]
    assert row_level and all("_bucket" in s for s in row_level)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan      # lang is pruned
    assert "BroadcastHashJoin" in plan                                   # bounded bucket bases


def test_budget_single_partition_only_on_bucket_totals(spark, tmp_path):
    docs = _docs(spark, tmp_path).select("doc_id", (F.octet_length("text") + 1).alias("n_tokens"))
    plan = _plan(token_budget(docs, 1000, "doc_id", n_buckets=4))
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    row_level = [s for s in specs if "doc_id" in s]
    assert row_level and all(s.startswith("_bucket") for s in row_level)  # rows: per bucket
    # the only unpartitioned window runs over the per-bucket totals
    assert all("_bucket" in s for s in specs)


def test_sampling_broadcasts_the_window_side(spark, tmp_path):
    docs = _docs(spark, tmp_path).select("doc_id", F.lit("train").alias("split"), "text",
                                         (F.octet_length("text") + 1).alias("n_tokens"))
    offs = stream_offsets(docs, "doc_id", n_buckets=4)
    plan = _plan(sample_windows(offs, 8, 16))
    assert plan.count("BroadcastHashJoin") >= 2
    assert "LeftSemi" in plan                                            # only touched docs
