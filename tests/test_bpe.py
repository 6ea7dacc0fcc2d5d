"""T1 with the BPE plug-in (rank file on shared storage) through the materialising path."""

import base64

from pyspark.sql import functions as F

from quire.operators.pack import pack_blocks
from quire.operators.tokenize import BpeTokenizer, detokenize_col, tokenize
from quire.plans.corpus import tokenized_corpus
from quire.session import scratch_path


def _rank_file(spark):
    ranks = [bytes([b]) for b in range(256)] + [b"th", b"he", b"the", b" the", b"in", b"ing"]
    path = scratch_path(spark, "t-ranks").replace("file:", "") + ".tiktoken"
    with open(path, "wb") as fh:
        for i, tok in enumerate(ranks):
            fh.write(base64.b64encode(tok) + b" " + str(i).encode() + b"\n")
    return path


def test_bpe_tokenize_decode_and_pack(spark):
    tok = BpeTokenizer(_rank_file(spark))
    assert tok.eot_id == 262 and tok.vocab_size == 263
    texts = [(1, "the thing in the ring"), (2, ""), (3, "théâtre <|endoftext|> the"), (5, "x" * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    toks = tokenize(df, "text", tok)
    got = {r["doc_id"]: r["tokens"] for r in toks.collect()}
    for i, t in texts:
        assert got[i] == tok.encode_ordinary(t) + [262]
        assert tok.decode(got[i][:-1]) == t
    dec = dict(toks.select("doc_id", detokenize_col(F.col("tokens"), tok)).collect())
    assert dec[1] == "the thing in the ring<|endoftext|>"

    corpus = tokenized_corpus(df, tok, fraction=0.0)           # all train, materialised once
    blocks = {r["block_id"]: r["tokens"] for r in pack_blocks(corpus, 4).collect()}
    flat = [x for i, t in sorted(texts) for x in tok.encode_ordinary(t) + [262]]
    assert len(blocks) == (len(flat) - 1) // 4
    for k, b in blocks.items():
        assert b == flat[4 * k: 4 * k + 5]
