"""Driver contract: entry() smoke, every query vs its DuckDB oracle (sf0.001), streams."""

import os

import pytest

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data absent")


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["split", "n_docs", "n_tokens", "n_blocks"]
    assert sum(r["n_docs"] for r in rows) == 200


def test_every_query_has_builder_and_most_have_oracles():
    import __spark_entry__ as E
    from quire.plans.registry import QUERIES

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {name for name in q if name in QUERIES}
    assert len(own) >= 44
    assert own <= set(o)


@pytest.mark.skipif(os.environ.get("QUIRE_FAST") == "1", reason="QUIRE_FAST=1")
def test_all_queries_match_oracles(spark):
    import __spark_entry__  # noqa: F401  (registers the queries)
    from quire.plans.registry import QUERIES
    from tests.oracle_harness import check

    res = check(spark, SMOKE, list(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    assert not bad, bad


def test_stream_replay_is_idempotent(spark):
    """ST2: running the same budgeted stream twice over one checkpoint keeps one result."""
    from pyspark.sql import functions as F

    from quire.session import scratch_path
    from quire.streaming.ingest import file_stream, stage_in_order, stream_budget

    root = scratch_path(spark, "t-st2")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    stage_in_order(docs, "doc_id", 3, f"{root}/in")
    for _ in range(2):
        src = file_stream(spark, f"{root}/in", docs.schema, max_files_per_trigger=1)
        stream_budget(src, 50_000, f"{root}/out", f"{root}/ledger", f"{root}/_ck")
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == out.select("doc_id").distinct().count()
    assert out.agg(F.max("budget_start")).first()[0] < 50_000


def test_ledger_replay_same_batch_id(spark):
    """ST2: replaying batch 0 (as after a failure) leaves one copy and the same ledger."""
    from quire.session import scratch_path
    from quire.streaming.ingest import BudgetLedger

    root = scratch_path(spark, "t-ledger")
    b0 = spark.createDataFrame([(1, "aaaa"), (2, "bb")], "doc_id long, text string")
    b1 = spark.createDataFrame([(3, "cccccc"), (4, "d")], "doc_id long, text string")
    led = BudgetLedger(f"{root}/out", f"{root}/ledger", max_tokens=12)
    led(b0, 0)
    led(b0, 0)                                   # replay
    led(b1, 1)
    out = sorted((r["doc_id"], r["budget_start"]) for r in spark.read.parquet(f"{root}/out").collect())
    assert out == [(1, 0), (2, 5), (3, 8)]       # doc 3 crosses the budget and is kept
    assert led.reached
    led(spark.createDataFrame([(5, "e")], "doc_id long, text string"), 2)
    assert spark.read.parquet(f"{root}/out").count() == 3   # nothing after the budget


def test_stream_stops_at_the_budget_and_writes_tokens(spark):
    """ST2: the query ends with the budget, not with its input, and keeps the tokens."""
    from pathlib import Path

    from quire.session import scratch_path
    from quire.streaming.ingest import file_stream, stage_in_order, stream_budget

    root = scratch_path(spark, "t-st2-stop")
    texts = {i: f"text {i}" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage_in_order(docs, "doc_id", 60, f"{root}/in")
    src = file_stream(spark, f"{root}/in", docs.schema, max_files_per_trigger=1)
    assert stream_budget(src, 10, f"{root}/out", f"{root}/ledger", f"{root}/_ck").reached
    out = {r["doc_id"]: r["tokens"] for r in spark.read.parquet(f"{root}/out").collect()}
    assert out == {i: list(texts[i].encode()) + [256] for i in (0, 1)}
    begun = [p for p in Path(root.removeprefix("file:")).glob("_ck/offsets/*")]
    assert 0 < len(begun) < 50
