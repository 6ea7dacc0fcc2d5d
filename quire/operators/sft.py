"""Supervised fine-tuning examples with response-only labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import mask_labels
from quire.functions.hashing import md5_uniform
from quire.functions.text import format_prompt, py_strip
from quire.operators.split import SPLIT_SEED, VAL_FRACTION
from quire.operators.tokenize import ByteTokenizer, Tokenizer, token_udf


def build_sft(df: DataFrame, tokenizer: Tokenizer | None = None,
              key_cols: list[str] | None = None, fraction: float = VAL_FRACTION,
              seed: int = SPLIT_SEED) -> DataFrame:
    """Instruction rows -> ``(key..., split, prompt, prompt_len, tokens, labels, n_tokens)``.

    Prompt and response are encoded separately (T2): ``ids(prompt) ++
    ids(strip(output)) ++ [eot]``; labels per T3.  The split is a seeded hash
    draw of the key columns, independent of order and partitioning.
    """
    tok = tokenizer or ByteTokenizer()
    keys = key_cols or ["ex_id"]
    enc = token_udf(tok, add_eot=False)
    ex = df.select(*keys, format_prompt(F.col("instruction"), F.col("input")).alias("prompt"),
                   py_strip(F.col("output")).alias("response"))
    ex = ex.select(*keys, "prompt", enc(F.col("prompt")).alias("_p"),
                   enc(F.col("response")).alias("_o"))
    ex = ex.select(*keys, "prompt", F.size("_p").alias("prompt_len"),
                   F.concat("_p", "_o", F.array(F.lit(tok.eot_id))).alias("tokens"))
    ex = ex.withColumn("labels", mask_labels("tokens", "prompt_len"))
    ex = ex.withColumn("n_tokens", F.size("tokens"))
    split = F.when(md5_uniform(seed, *keys) < F.lit(fraction), F.lit("val")).otherwise(F.lit("train"))
    return ex.withColumn("split", split)


def _encode_sft(df: DataFrame, tok: Tokenizer) -> DataFrame:
    enc = token_udf(tok, add_eot=False)
    out = df.withColumn("_p", enc(F.col("prompt"))).withColumn("_o", enc(F.col("response")))
    out = out.withColumn("tokens", F.concat("_p", "_o", F.array(F.lit(tok.eot_id))))
    out = out.withColumn("labels", mask_labels("tokens", "prompt_len"))
    return out.drop("_p", "_o")


def sft_sequences(df: DataFrame, tokenizer: Tokenizer | None = None,
                  key_cols: list[str] | None = None, fraction: float = VAL_FRACTION,
                  seed: int = SPLIT_SEED, max_tokens: int = 0,
                  n_buckets: int | None = None,
                  quantile_source: DataFrame | None = None) -> DataFrame:
    """SFT examples with stream offsets: ``(key..., split, prompt_len, n_tokens, start,
    tokens, labels)``, budget P8 applied in key order (0 = unlimited).

    With the byte codec both lengths are JVM expressions, so split, budget and
    offsets run on narrow columns and the tokenizer runs once, at the end.  With
    another codec the examples are encoded once and materialised first.
    """
    from quire.operators.offsets import stream_offsets, token_budget
    from quire.session import materialize

    tok = tokenizer or ByteTokenizer()
    keys = key_cols or ["ex_id"]
    split = F.when(md5_uniform(seed, *keys) < F.lit(fraction), F.lit("val")).otherwise(F.lit("train"))
    plen = tok.length_expr(F.col("prompt"), False)
    if plen is None:
        ex = materialize(build_sft(df, tok, keys, fraction, seed), "sft")
    else:
        ex = df.select(*keys, format_prompt(F.col("instruction"), F.col("input")).alias("prompt"),
                       py_strip(F.col("output")).alias("response"))
        rlen = tok.length_expr(F.col("response"), False)
        ex = ex.select(*keys, "prompt", "response", split.alias("split"),
                       plen.cast("int").alias("prompt_len"),
                       (plen + rlen + 1).cast("int").alias("n_tokens"))
    if max_tokens:
        ex = token_budget(ex, max_tokens, keys, zero_is_unlimited=True, n_buckets=n_buckets,
                          quantile_source=quantile_source).drop("budget_start")
    seqs = stream_offsets(ex, keys, n_buckets=n_buckets, quantile_source=quantile_source)
    if plen is None:
        return seqs
    return _encode_sft(seqs, tok).drop("prompt", "response")
