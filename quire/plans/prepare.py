"""The reference's two preparation scripts as Spark jobs.

``prepare_corpus``: documents -> split -> budget (pre-train form) -> offsets ->
tokens -> ``tokenbin`` train/val streams + token metadata -> report.
``prepare_sft``: instruction rows -> prompt template -> separate encoding ->
response-only labels -> split -> budget (0 = unlimited) -> aligned token/label
streams -> report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import count_where
from quire.operators.report import GIB, LABEL_BYTES, TOKEN_BYTES, corpus_report
from quire.operators.sft import sft_sequences
from quire.operators.split import SPLIT_SEED, VAL_FRACTION
from quire.operators.tokenize import ByteTokenizer, Tokenizer
from quire.plans.corpus import tokenized_corpus
from quire.sources.tokenbin import stream_state, write_sft_bins, write_token_stream

SPLITS = ("train", "val")

# Fixed value of the pre-train preparation: the token budget.
PRETRAIN_MAX_TOKENS = 7_000_000_000


def prepare_corpus(docs: DataFrame, out_path: str, tokenizer: Tokenizer | None = None,
                   max_tokens: int | None = PRETRAIN_MAX_TOKENS, fraction: float = VAL_FRACTION,
                   seed: int = SPLIT_SEED) -> DataFrame:
    """Write ``out_path/train`` and ``out_path/val`` token streams; return the report.

    The split draw is seeded (the reference's is not), the budget counts both
    splits and keeps the crossing document.
    """
    tok = tokenizer or ByteTokenizer()
    toks = tokenized_corpus(docs, tok, fraction=fraction, seed=seed, max_tokens=max_tokens)
    _write(toks, out_path, tok, "overwrite")
    return corpus_report(toks, max_tokens=max_tokens)


def _write(toks: DataFrame, out_path: str, tok: Tokenizer, mode: str) -> None:
    last = toks.agg(F.max("doc_id")).first()[0]     # of the narrow columns
    write_token_stream(toks, out_path, route_col="split", vocab_size=tok.vocab_size,
                       eot_id=tok.eot_id, repartition=False, mode=mode, last_key=last)


def continue_corpus(docs: DataFrame, out_path: str, tokenizer: Tokenizer | None = None,
                    max_tokens: int | None = PRETRAIN_MAX_TOKENS, fraction: float = VAL_FRACTION,
                    seed: int = SPLIT_SEED) -> DataFrame:
    """Add the documents past the last prepared id to the streams in ``out_path``; report them.

    Offsets, budget and order go on from the streams' manifests (tokens so far and last
    id of each split), so ``prepare_corpus`` of a whole corpus and runs over its growing
    parts leave the same streams, and what is there is never read again.  Run twice over
    the same documents, or again after a run that was cut off between its two streams, it
    adds what is missing and nothing twice.  New ids must be larger than prepared ones.
    """
    tok = tokenizer or ByteTokenizer()
    states = {s: stream_state(f"{out_path.rstrip('/')}/{s}") for s in SPLITS}
    after = {s: x["last_key"] if x else None for s, x in states.items()}
    before = {s: x["n_tokens"] if x else 0 for s, x in states.items()}
    done = sum(before.values())
    left = max_tokens
    if max_tokens is not None and done:
        left = max_tokens - done
        if left <= 0:
            docs, left = docs.limit(0), None
    toks = tokenized_corpus(docs, tok, fraction=fraction, seed=seed, max_tokens=left, after=after)
    base = F.lit(0).cast("bigint")
    for split, n in before.items():
        base = F.when(F.col("split") == split, F.lit(n)).otherwise(base)
    toks = toks.withColumn("start", F.col("start") + base)
    if not toks.select("doc_id").isEmpty():
        _write(toks, out_path, tok, "append")
    return corpus_report(toks, max_tokens=left)


def prepare_sft(instructions: DataFrame, out_path: str, tokenizer: Tokenizer | None = None,
                max_tokens: int = 0, fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED,
                key_cols: list[str] | None = None) -> DataFrame:
    """Write aligned ``tokens`` (uint16) / ``labels`` (int32) streams per split; report."""
    keys = key_cols or ["ex_id"]
    seqs = sft_sequences(instructions, tokenizer, keys, fraction, seed, max_tokens)
    write_sft_bins(seqs, out_path, repartition=False)
    return seqs.groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_examples"),
        F.sum("n_tokens").cast("bigint").alias("n_tokens"),
        F.sum(count_where("labels", lambda x: x != -1)).cast("bigint").alias("n_labeled"),
        F.round(F.sum("n_tokens") * TOKEN_BYTES / GIB, 9).alias("tokens_gib"),
        F.round(F.sum("n_tokens") * LABEL_BYTES / GIB, 9).alias("labels_gib"))
