"""Corpus preparation job (the reference's pre-train preparation, Spark-first).

documents -> split (hash draw) -> token counts -> stream offsets (two-phase
prefix sum) -> [budget] -> tokens -> fixed blocks / token files / report.

With the byte codec the token count is a JVM expression (``octet_length``), so
offsets and budget are computed on ``(doc_id, split, n_tokens)`` alone and the
tokenizer runs once, after the budget filter.  With a BPE codec the tokens are
computed once and materialised in shared storage before the offsets pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.offsets import stream_offsets, token_budget
from quire.operators.pack import pack_blocks
from quire.operators.report import corpus_report
from quire.operators.scan import default_buckets
from quire.operators.split import SPLIT_SEED, VAL_FRACTION, assign_split
from quire.operators.tokenize import ByteTokenizer, Tokenizer, token_count, tokenize
from quire.session import materialize

# Tokens of an order bucket, where the tokens are too many for the buckets a session has.
BUCKET_TOKENS = 1 << 25


def buckets_for(spark, n_tokens: int) -> int | None:
    """Order buckets, and tasks to deal them to, for so many tokens; None: the session's number."""
    n = -(-n_tokens // BUCKET_TOKENS)
    return n if n > default_buckets(spark) else None


def _within_budget(rows: DataFrame, lengths: DataFrame, max_tokens: int, id_col: str,
                   total: int) -> DataFrame:
    """``rows`` up to the last id the budget keeps, of ``total`` tokens.

    A budget above the total keeps every id.  Another is settled on ``lengths(id, n_tokens)``
    alone; what comes of it is one id, a literal that the scan of the texts can push down,
    so no text beyond it is read into an exchange.  Ids are unique.
    """
    if total < max_tokens:
        return rows.where(F.col(id_col).isNotNull())
    last = token_budget(lengths, max_tokens, id_col).agg(F.max(id_col)).first()[0]
    return rows.limit(0) if last is None else rows.where(F.col(id_col) <= F.lit(last))


def tokenized_corpus(docs: DataFrame, tokenizer: Tokenizer | None = None,
                     id_col: str = "doc_id", text_col: str = "text",
                     fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED,
                     max_tokens: int | None = None, n_buckets: int | None = None,
                     with_tokens: bool = True, keep_text: bool = True,
                     after: dict | None = None) -> DataFrame:
    """``(doc_id, split, n_tokens, start, tokens)`` for every kept document.

    ``with_tokens=False`` (byte codec) returns ``text`` instead of ``tokens`` so a
    consumer that needs only some documents tokenizes just those;
    ``keep_text=False`` returns narrow offsets (no text through the shuffle).
    ``after`` (split -> last id that its stream holds, or None) leaves out what is there
    already; the lowest of these ids bounds the scan of the texts.  The tokens are summed
    first: buckets and tasks of the exchange that carries the texts grow with that sum.
    """
    tok = tokenizer or ByteTokenizer()
    base = assign_split(docs.select(id_col, text_col), id_col, fraction, seed)
    lasts = list((after or {}).values())
    if lasts and None not in lasts:
        base = base.where(F.col(id_col) > F.lit(min(lasts)))
    for split, last in (after or {}).items():
        if last is not None:
            base = base.where((F.col("split") != split) | (F.col(id_col) > F.lit(last)))
    if tok.length_expr(F.col(text_col), True) is not None:
        counted = base.withColumn("n_tokens", token_count(F.col(text_col), tok))
        counted = counted.select(id_col, "split", "n_tokens",
                                 *([text_col] if (with_tokens or keep_text) else []))
        total = _total(counted) if max_tokens is not None or text_col in counted.columns else 0
        if max_tokens is not None:
            counted = _within_budget(counted, counted.select(id_col, "n_tokens"), max_tokens,
                                     id_col, total)
        with_start = _with_start(counted, id_col, n_buckets, total)
        if not with_tokens:
            return with_start
        return tokenize(with_start, text_col, tok, len_col=None).drop(text_col)
    toks = materialize(tokenize(base, text_col, tok).drop(text_col), "tokens")
    total = _total(toks)
    if max_tokens is not None:
        toks = _within_budget(toks, toks.select(id_col, "n_tokens"), max_tokens, id_col, total)
    return _with_start(toks, id_col, n_buckets, total)


def _total(counted: DataFrame) -> int:
    return int(counted.agg(F.sum(F.col("n_tokens").cast("bigint"))).first()[0] or 0)


def _with_start(rows: DataFrame, id_col: str, n_buckets: int | None, total: int) -> DataFrame:
    parts = None if n_buckets else buckets_for(rows.sparkSession, total)
    return stream_offsets(rows, id_col, n_buckets=n_buckets or parts, n_parts=parts)


def corpus_blocks_report(docs: DataFrame, block_size: int = 512,
                         tokenizer: Tokenizer | None = None,
                         n_buckets: int | None = None) -> DataFrame:
    """Flagship: per split documents, tokens and full blocks of ``block_size``."""
    tok = tokenizer or ByteTokenizer()
    toks = tokenized_corpus(docs, tok, n_buckets=n_buckets)
    if tok.length_expr(F.col("text"), True) is not None:
        # counts need no offsets: aggregate the narrow (split, length) columns
        narrow = assign_split(docs.select("doc_id", "text")).select(
            "split", token_count(F.col("text"), tok).alias("n_tokens"))
        rep = corpus_report(narrow)
    else:
        rep = corpus_report(toks)
    blocks = pack_blocks(toks, block_size).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_blocks"))
    return rep.join(blocks, "split", "left").select(
        "split", "n_docs", "n_tokens", F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"))
