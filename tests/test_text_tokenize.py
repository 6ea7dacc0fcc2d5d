"""P2 P3 P4 T1 T4 T5 T6 T7 W8 on hand-made edge rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions.arrays import crop_context
from quire.functions.text import EOT_TEXT, extract_response, format_prompt, inference_prompt, \
    py_strip
from quire.operators.tokenize import ByteTokenizer, detokenize_col, tokenize

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_py_strip_matches_python_for_every_whitespace(spark):
    assert len(WS) == 29
    vals = [w + "a b" + w for w in WS] + ["", "   ", "​ x ​", None, "　\u001c\t x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = dict(df.select("i", py_strip("s").alias("t")).collect())
    for i, v in enumerate(vals):
        assert got[i] == (v or "").strip()


def _fmt(ins, inp):
    ins, inp = (ins or "").strip(), (inp or "").strip()
    if inp:
        return f"### Instruction:\n{ins}\n\n### Input:\n{inp}\n\n### Response:\n"
    return f"### Instruction:\n{ins}\n\n### Response:\n"


def test_format_prompt_two_and_three_sections(spark):
    cases = [("Do it", None), ("  Do it\t", "ctx"), (None, None), ("x", " 　"),
             ("\u001cq", " input "), ("", "")]
    df = spark.createDataFrame(cases, "ins string, inp string")
    got = [r[0] for r in df.select(format_prompt("ins", "inp")).collect()]
    assert got == [_fmt(a, b) for a, b in cases]


def test_inference_prompt_keeps_leading_spaces(spark):
    df = spark.createDataFrame([("  hi ",)], "ins string")
    assert df.select(inference_prompt("ins")).first()[0] == \
        "### Instruction:\n  hi \n\n### Response:\n"


@pytest.mark.parametrize("gen,expect", [
    ("answer", "answer"),
    (" answer " + EOT_TEXT + "tail", "answer"),
    ("a" + EOT_TEXT + "b" + EOT_TEXT + "c", "a"),
    (EOT_TEXT + "rest", ""),
    ("réponse ü" + EOT_TEXT, "réponse ü"),
])
def test_extract_response(spark, gen, expect):
    prompt = "### Instruction:\nélan\n\n### Response:\n"
    df = spark.createDataFrame([(prompt, prompt + gen)], "p string, f string")
    assert df.select(extract_response("f", "p")).first()[0] == expect


DOCS = [(10, ""), (11, "a"), (15, "héllo wörld ✓ 漢字"), (40, "x<|endoftext|>y"),
        (41, "long " * 700)]


def test_byte_tokens_and_counts(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    toks = tokenize(df, "text")
    got = {r["doc_id"]: (r["tokens"], r["n_tokens"]) for r in toks.collect()}
    for i, t in DOCS:
        want = list(t.encode("utf-8")) + [256]
        assert got[i] == (want, len(want))


def test_no_eot_and_strict_special(spark):
    df = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert tokenize(df, add_eot=False).first()["tokens"] == list(b"plain")
    bad = spark.createDataFrame([(1, "has <|endoftext|> inside")], "doc_id long, text string")
    with pytest.raises(Exception):
        tokenize(bad, add_eot=False, on_special="raise").collect()


def test_detokenize_roundtrip_and_invalid_utf8(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    dec = tokenize(df).select("doc_id", "text", detokenize_col(F.col("tokens")).alias("d"))
    for r in dec.collect():
        assert r["d"] == r["text"] + EOT_TEXT
    cut = spark.createDataFrame([([0xC3],)], "t array<int>")
    assert cut.select(detokenize_col(F.col("t"))).first()[0] == "�"
    assert ByteTokenizer().decode([104, 105, 256]) == "hi" + EOT_TEXT


def test_crop_context(spark):
    df = spark.createDataFrame([([],), ([1, 2, 3],), (list(range(10)),)], "t array<int>")
    got = [r[0] for r in df.select(crop_context("t", 4)).collect()]
    assert got == [[], [1, 2, 3], [6, 7, 8, 9]]
