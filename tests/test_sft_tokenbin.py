"""S2 S5 T2 T3 K1 K2 K3 S3 S4 on hand-made rows."""

import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.arrays import mask_labels
from quire.operators.offsets import stream_offsets
from quire.operators.sft import build_sft
from quire.session import scratch_path
from quire.sources.corpus import conversations_to_instructions, normalize_instructions
from quire.sources.tokenbin import read_token_meta, read_token_stream, write_sft_bins, \
    write_token_stream


def _labels(full, p):
    """Ignored prompt prefix, the response shifted by one, nothing after the last token."""
    ignored = min(max(p - 1, 0), max(len(full) - 1, 0))
    return ([-1] * ignored + full[ignored + 1:] + [-1])[:len(full)]


@pytest.mark.parametrize("full,p,want", [
    ([5, 6, 7, 256], 2, [-1, 7, 256, -1]), ([5, 6, 7, 256], 0, [6, 7, 256, -1]),
    ([5, 6, 7, 256], 1, [6, 7, 256, -1]), ([5, 6, 7, 256], 4, [-1, -1, -1, -1]),
    ([5, 6, 7, 256], 9, [-1, -1, -1, -1]), ([5], 0, [-1]), ([], 0, [])])
def test_mask_labels_examples(spark, full, p, want):
    df = spark.createDataFrame([(full, p)], "t array<int>, p int")
    assert df.select(mask_labels("t", "p")).first()[0] == want == _labels(full, p)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 300), max_size=12), st.integers(0, 14)),
                min_size=1, max_size=40))
def test_mask_labels_property(spark, cases):
    df = spark.createDataFrame(cases, "t array<int>, p int")
    got = [r[0] for r in df.select(mask_labels("t", "p")).collect()]
    assert got == [_labels(t, p) for t, p in cases]


def test_mask_label_edges(spark):
    cases = [([5], 0), ([5], 1), ([1, 2, 256], 0), ([1, 2, 256], 2), ([1, 2, 256], 3), ([], 0)]
    df = spark.createDataFrame(cases, "t array<int>, p int")
    assert [r[0] for r in df.select(mask_labels("t", "p")).collect()] == \
        [_labels(t, p) for t, p in cases]


def test_build_sft_on_instruction_edges(spark):
    rows = [(1, "Say hi", None, "hi"), (2, None, None, None), (3, "\t", " ", "　"),
            (4, "Add", " 2 and 3 ", " 5 "), (5, "\u001cq", "", ""), (9, "x", "y", "")]
    df = spark.createDataFrame(rows, "ex_id long, instruction string, input string, output string")
    got = {r["ex_id"]: r for r in build_sft(normalize_instructions(df)).collect()}
    for ex_id, ins, inp, out in rows:
        ins_s, inp_s = (ins or "").strip(), (inp or "").strip()
        prompt = (f"### Instruction:\n{ins_s}\n\n### Input:\n{inp_s}\n\n### Response:\n" if inp_s
                  else f"### Instruction:\n{ins_s}\n\n### Response:\n")
        p = list(prompt.encode())
        full = p + list((out or "").strip().encode()) + [256]
        r = got[ex_id]
        assert r["prompt"] == prompt and r["prompt_len"] == len(p)
        assert r["tokens"] == full and r["labels"] == _labels(full, len(p))
        assert r["split"] in ("train", "val")


def test_absent_columns_become_empty(spark):
    df = spark.createDataFrame([(1, "only instruction")], "ex_id long, instruction string")
    n = normalize_instructions(df).first()
    assert (n["input"], n["output"]) == ("", "")


def test_conversation_pairs(spark):
    conv = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
            (1, 3, "user", "u2"), (2, 5, "user", "x"), (2, 9, "assistant", "y"),
            (3, 0, "assistant", "a"), (3, 1, "user", "b")]
    df = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["instruction"], r["output"])
                 for r in conversations_to_instructions(df, n_buckets=2).collect())
    assert got == [(1, 1, "u1", "a1"), (2, 5, "x", "y")]


def _stream(spark, seqs):
    df = spark.createDataFrame(seqs, "doc_id long, split string, tokens array<int>")
    return stream_offsets(df.withColumn("n_tokens", F.size("tokens")), "doc_id")


def test_tokenbin_roundtrip_and_sidecar(spark):
    rnd = random.Random(1)
    seqs = [(i, "train" if i % 5 else "val", [rnd.randint(0, 65535) for _ in range(rnd.randint(1, 50))])
            for i in range(200)]
    root = scratch_path(spark, "t-tokenbin")
    write_token_stream(_stream(spark, seqs).repartition(6), root, route_col="split",
                       vocab_size=50304, eot_id=50256)
    for split in ("train", "val"):
        flat = [t for i, s, ts in seqs if s == split for t in ts]
        back = read_token_stream(spark, f"{root}/{split}", chunk_tokens=97, row_tokens=13)
        rows = sorted((r["offset"], r["tokens"]) for r in back.collect())
        got = [t for _o, ts in rows for t in ts]
        assert got == flat
        assert [o for o, _ in rows] == sorted({o for o, _ in rows})
        path = f"{root}/{split}".replace("file:", "")
        raw = b"".join(open(os.path.join(path, f), "rb").read()
                       for f in sorted(os.listdir(path)) if f.endswith(".bin"))
        assert np.frombuffer(raw, "<u2").tolist() == flat   # concatenation = the flat file
        meta = read_token_meta(spark, f"{root}/{split}").first()
        assert (meta["vocab_size"], meta["eot_id"], meta["n_tokens"]) == (50304, 50256, len(flat))


def test_token_meta_default_vocab(spark):
    root = scratch_path(spark, "t-meta").replace("file:", "")
    os.makedirs(root)
    with open(os.path.join(root, "token_meta.json"), "w") as fh:
        json.dump({"dtype": "uint16", "n_tokens": 3}, fh)
    assert read_token_meta(spark, root).first()["vocab_size"] == 50304


@pytest.mark.parametrize("bad", [65536, -1])
def test_uint16_range_check(spark, bad):
    root = scratch_path(spark, "t-range")
    with pytest.raises(Exception):
        write_token_stream(_stream(spark, [(1, "train", [0, 65535, bad])]), root)


def test_uint16_limits_ok_and_raw_file(spark):
    root = scratch_path(spark, "t-ok")
    write_token_stream(_stream(spark, [(1, "train", [0, 65535])]), root)
    assert [t for r in read_token_stream(spark, root).collect() for t in r["tokens"]] == [0, 65535]
    raw = root.replace("file:", "") + "-raw.bin"
    np.array([7, 8, 9], dtype="<u2").tofile(raw)
    assert read_token_stream(spark, raw).first()["tokens"] == [7, 8, 9]
    empty = root.replace("file:", "") + "-empty.bin"
    open(empty, "wb").close()
    assert read_token_stream(spark, empty).count() == 0


def test_sft_bins_aligned(spark):
    rows = [(i, "a" * (i % 7), "b" * (i % 5)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "ex_id long, instruction string, output string")
    sft = build_sft(normalize_instructions(df))
    seqs = stream_offsets(sft.select("ex_id", "split", "n_tokens", "tokens", "labels"), "ex_id")
    root = scratch_path(spark, "t-sft")
    write_sft_bins(seqs, root)
    for split in ("train", "val"):
        exp = sorted((r["ex_id"], r["tokens"], r["labels"]) for r in sft.collect()
                     if r["split"] == split)
        if not exp:
            continue
        t = [x for r in sorted(read_token_stream(spark, f"{root}/tokens/{split}").collect(),
                               key=lambda r: r["offset"]) for x in r["tokens"]]
        lab = [x for r in sorted(read_token_stream(spark, f"{root}/labels/{split}", "int32").collect(),
                                 key=lambda r: r["offset"]) for x in r["tokens"]]
        assert t == [x for e in exp for x in e[1]]
        assert lab == [x for e in exp for x in e[2]]


def _bin_rows(spark, rows):
    return spark.createDataFrame(rows, "start long, tokens array<int>")


def _bin_read(spark, path, **kw):
    out = sorted((r["offset"], r["tokens"]) for r in read_token_stream(spark, path, **kw).collect())
    assert [o for o, _ in out] == [sum(len(t) for _, t in out[:k]) for k in range(len(out))]
    return [x for _, t in out for x in t]


def test_tokenbin_dtype_comes_from_the_manifest(spark):
    root = scratch_path(spark, "t-dtype")
    write_token_stream(_bin_rows(spark, [(0, [5, -1, 70000])]), root, dtype="int32")
    assert _bin_read(spark, root) == [5, -1, 70000]
    with pytest.raises(Exception, match="holds int32"):
        read_token_stream(spark, root, "uint16").collect()


def test_tokenbin_append_continues_and_overwrite_replaces(spark):
    root = scratch_path(spark, "t-append")
    write_token_stream(_bin_rows(spark, [(0, [1, 1])]), root)
    write_token_stream(_bin_rows(spark, [(2, [2, 2])]), root, mode="append")
    assert _bin_read(spark, root) == [1, 1, 2, 2]
    with pytest.raises(Exception, match="expected 4"):
        write_token_stream(_bin_rows(spark, [(2, [3])]), root, mode="append")
    assert _bin_read(spark, root) == [1, 1, 2, 2]
    write_token_stream(_bin_rows(spark, [(0, [9])]), root)
    assert _bin_read(spark, root) == [9]
    assert len([f for f in os.listdir(root.replace("file:", "")) if f.endswith(".bin")]) == 1


def test_tokenbin_refuses_a_missing_head(spark):
    with pytest.raises(Exception, match="expected 0"):
        write_token_stream(_bin_rows(spark, [(50, [1])]), scratch_path(spark, "t-head"))


def test_tokenbin_empty_folder_is_no_dataset(spark):
    root = scratch_path(spark, "t-none").replace("file:", "")
    os.makedirs(root)
    with pytest.raises(Exception, match="no token files"):
        read_token_stream(spark, root).collect()
