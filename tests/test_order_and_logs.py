"""Whole-key buckets, one-pass packing and early stop, the compacted run log."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.offsets import stream_offsets
from quire.operators.pack import pack_blocks
from quire.operators.runlog import early_stop, read_run_log, write_run_log
from quire.operators.scan import BUCKET, add_order_bucket, prefix_aggregate
from quire.session import scratch_path


def sizes(df, keys, n):
    return [r["count"] for r in add_order_bucket(df, keys, n).groupBy(BUCKET).count().collect()]


def urls(n, rnd):
    return [f"{rnd.choice(['http', 'https'])}://{rnd.choice(['', 'www.'])}"
            f"{rnd.choice('abcdefgh') * rnd.randint(1, 6)}.org/{rnd.randrange(10**9)}"
            for _ in range(n)]


def test_mixed_urls_fill_the_buckets_evenly(spark):
    df = spark.createDataFrame([(u,) for u in urls(40_000, random.Random(1))], "url string")
    n = sizes(df, "url", 16)
    assert len(n) == 16 and max(n) <= 2 * 40_000 / 16


def test_a_hot_conversation_is_cut_by_its_turns(spark):
    rows = [(7, k) for k in range(10_000)] + [(k, t) for k in range(100, 4100) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long").repartition(4)
    n = sizes(df, ["conv_id", "turn"], 16)
    assert len(n) == 16 and max(n) <= 2 * len(rows) / 16
    got = stream_offsets(df.withColumn("n_tokens", F.col("turn") % 3 + 1), ["conv_id", "turn"],
                         split_col=None, n_buckets=16).orderBy("conv_id", "turn").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_a_sample_of_a_large_table_still_balances(spark, monkeypatch):
    import quire.operators.scan as scan

    monkeypatch.setattr(scan, "LEAST_SAMPLE", 1000)
    df = spark.range(60_000).select((F.col("id") * F.col("id")).alias("k")).repartition(5)
    n = sizes(df, "k", 12)
    assert len(n) == 12 and max(n) <= 2 * 60_000 / 12


@pytest.mark.parametrize("kind,values", [
    ("string", ["", "a", "Z", "é", "日本", "\U0001F600", "~", "http://x", "https://x", '"\\,[']),
    ("double", [float("-inf"), -1.5, -0.0, 1e-300, 2.0, float("inf"), float("nan")]),
    ("timestamp", [datetime.datetime(2020, 3, 29, 1, 59, 59, 999_999),
                   datetime.datetime(1969, 12, 31, 23), datetime.datetime(2038, 1, 19)]),
    ("timestamp_ntz", [datetime.datetime(2021, 10, 31, 2, 30), datetime.datetime(1900, 1, 1)]),
    ("date", [datetime.date(2020, 2, 29), datetime.date(1, 1, 1), datetime.date(9999, 12, 31)]),
    ("binary", [b"", b"\x00", b"\xff\x00", b"a", b"\x7f\x80"]),
    ("boolean", [True, False]), ("int", [-5, 0, 3, 2**31 - 1]),
])
def test_running_counts_follow_the_order_of_any_key_type(spark, kind, values):
    rows = [(v, k) for k in range(9) for v in values]
    df = spark.createDataFrame(rows, f"key {kind}, tie long").repartition(3)
    out = prefix_aggregate(df, ["key", "tie"], {"pos": ("count", F.lit(1))}, n_buckets=7)
    got = [r["pos"] for r in out.orderBy("key", "tie").collect()]
    assert got == list(range(len(rows)))


def test_packing_reads_its_input_once_and_sends_only_edges(spark):
    rnd = random.Random(5)
    seqs = [(i, rnd.choice(["train", "val"]), [rnd.randrange(257) for _ in range(rnd.randint(1, 900))])
            for i in range(300)]
    df = spark.createDataFrame(seqs, "doc_id long, split string, tokens array<int>")
    offs = stream_offsets(df.withColumn("n_tokens", F.size("tokens")), "doc_id", n_buckets=2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = offs.mapInArrow(count, offs.schema)
    a = pack_blocks(watched, 16, method="local")
    got = {(r["split"], r["block_id"]): r["tokens"] for r in a.collect()}
    assert seen.value == len(seqs)
    for split in ("train", "val"):
        stream = [t for _, s, ts in seqs if s == split for t in ts]
        for k in range((len(stream) - 1) // 16):
            assert got.pop((split, k)) == stream[16 * k:16 * k + 17]
    assert not got


def loop(vals, limit):
    best, patience, low, low_at = 1e9, 0, None, None
    for i, v in enumerate(vals):
        if v is not None and v == v and (low is None or v < low):
            low, low_at = v, i
        if v is not None and v < best:
            best, patience = v, 0
        else:
            patience += 1
        if limit and patience >= limit:
            return i * 10, i + 1, low, None if low_at is None else low_at * 10
    return None, len(vals), low, None if low_at is None else low_at * 10


@pytest.mark.parametrize("limit", [0, 1, 2, 4, 9])
@pytest.mark.parametrize("buckets", [1, 5, 16])
def test_early_stop_over_segments_equals_the_loop(spark, limit, buckets):
    rnd = random.Random(limit * 100 + buckets)
    runs = {0: [], 1: [2e9, 3e9, 1.5e9, 1e9, 5.0], 2: [None, float("nan"), 3.0, 3.0, None, 2.0],
            3: [float("nan")] * 6, 4: [float(60 - k) for k in range(60)], 5: [1.0] * 30}
    for run in range(6, 60):
        level, vals = 10.0, []
        for _ in range(rnd.randint(1, 70)):
            if rnd.random() < 0.25:
                level -= rnd.random()
            vals.append(rnd.choice([level, level + rnd.random(), level, None if rnd.random() < .1 else 11.0]))
        runs[run] = vals
    rows = [(r, 10 * i, v) for r, vals in runs.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run_id long, iter long, val_loss double").repartition(3)
    got = {r["run_id"]: tuple(r)[1:] for r in early_stop(df, limit, n_buckets=buckets).collect()}
    assert set(got) == {r for r, vals in runs.items() if vals}
    for run, found in got.items():
        assert found == loop(runs[run], limit), run


def test_early_stop_has_two_exchanges(spark):
    df = spark.createDataFrame([(1, k, 1.0) for k in range(50)],
                               "run_id long, iter long, val_loss double").withColumn(
        BUCKET, F.floor(F.col("iter") / 10).cast("int"))
    plan = early_stop(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


LOG = "run_id long, iter long, train_loss double, val_loss double, lr double, mfu double"


def test_run_log_files_are_bounded_and_appends_idempotent(spark):
    path = scratch_path(spark, "t-log")
    rows = spark.range(100_000).select(
        F.col("id").alias("run_id"), F.lit(0).cast("long").alias("iter"),
        *[F.lit(None).cast("double").alias(c) for c in ("train_loss",)],
        F.rand(1).alias("val_loss"), F.lit(0.1).alias("lr"), F.lit(0.2).alias("mfu"))
    for _ in range(2):
        write_run_log(rows, path, n_buckets=8)
    files = [f for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs
             if f.endswith(".parquet")]
    assert len(files) == 8
    assert read_run_log(spark, path).count() == 100_000


def test_run_log_replaces_by_run_and_iteration(spark):
    path = scratch_path(spark, "t-log2")
    make = lambda rows: spark.createDataFrame(rows, LOG)
    write_run_log(make([(1, i, 1.0, 9.0, 0.1, 0.2) for i in range(10)]), path)
    write_run_log(make([(1, 3, 1.0, 5.0, 0.1, 0.2), (2, 0, None, None, None, None)]), path)
    write_run_log(make([]), path)
    got = {(r["run_id"], r["iter"]): r["val_loss"] for r in read_run_log(spark, path).collect()}
    assert got == {**{(1, i): 9.0 for i in range(10)}, (1, 3): 5.0, (2, 0): None}


def test_a_second_writer_of_one_version_fails(spark):
    from quire.sources.versions import ConcurrentWrite, latest, publish

    path = scratch_path(spark, "t-versions")
    assert latest(spark, path) == (-1, None)
    publish(spark, path, 0, {"a": 1})
    with pytest.raises(ConcurrentWrite):
        publish(spark, path, 0, {"a": 2})
    publish(spark, path, 11, {"a": 3})
    assert latest(spark, path) == (11, {"a": 3})
