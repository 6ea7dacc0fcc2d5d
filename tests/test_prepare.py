"""§3.1 / §3.2 end to end on small inputs, against the reference loops restated in Python."""

import hashlib

from quire.plans.prepare import prepare_corpus, prepare_sft
from quire.session import scratch_path
from quire.sources.corpus import normalize_instructions
from quire.sources.tokenbin import read_token_stream


def _split(seed, *keys, fraction=0.25):
    h = hashlib.md5(":".join([str(seed)] + [str(k) for k in keys]).encode()).hexdigest()[:8]
    return "val" if int(h, 16) / 4294967296.0 < fraction else "train"


def _flat(spark, path, dtype="uint16"):
    rows = sorted(read_token_stream(spark, path, dtype).collect(), key=lambda r: r["offset"])
    return [t for r in rows for t in r["tokens"]]


def test_prepare_corpus_budget_and_streams(spark):
    texts = [(i, ("doc %d " % i) * (i % 7 + 1)) for i in range(0, 120, 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = scratch_path(spark, "t-prep")
    rep = {r["split"]: r for r in prepare_corpus(df, out, max_tokens=600, fraction=0.25).collect()}
    want = {"train": [], "val": []}
    total = 0
    for i, t in texts:                                   # the reference's write/stop loop
        toks = list(t.encode()) + [256]
        want[_split(1337, i)].extend(toks)
        total += len(toks)
        if total >= 600:
            break
    for split in ("train", "val"):
        assert _flat(spark, f"{out}/{split}") == want[split]
        if want[split]:
            assert rep[split]["n_tokens"] == len(want[split])
    assert all(r["stopped_early"] for r in rep.values())


def test_prepare_sft_streams(spark):
    rows = [(i, f"task {i}", "ctx" if i % 3 == 0 else None, f"answer {i}") for i in range(40)]
    df = normalize_instructions(spark.createDataFrame(
        rows, "ex_id long, instruction string, input string, output string"))
    out = scratch_path(spark, "t-prep-sft")
    rep = {r["split"]: r for r in prepare_sft(df, out, max_tokens=0).collect()}
    toks = _flat(spark, f"{out}/tokens/train")
    labs = _flat(spark, f"{out}/labels/train", "int32")
    assert len(toks) == len(labs) == rep["train"]["n_tokens"]
    assert sum(1 for x in labs if x != -1) == rep["train"]["n_labeled"]


def test_whole_corpus_query_writes_every_document(spark):
    from pyspark.sql import functions as F

    from quire.plans import all_queries  # noqa: F401  (registers the queries)
    from quire.plans.corpus_queries import BUDGET
    from quire.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{sf}/documents.parquet").agg(
        F.sum(F.octet_length("text") + 1)).first()[0]
    assert want > BUDGET
    found = QUERIES["prepare_corpus_whole"](spark, sf).collect()
    assert sum(r["n_tokens"] for r in found) == sum(r["meta_tokens"] for r in found) == want
