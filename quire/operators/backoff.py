"""M1/M2 with a longer context: n-gram counts of any order with continuation counts.

Every sequence is preceded by ``order - 1`` begin marks, so each id has a full context.
``counts[n]`` of an order below the highest are continuation counts: the number of distinct
ids seen before the n-gram.  A context is one number (its ids as digits), and shortening
it is arithmetic, so all lookups are equi-joins on whole numbers.

Scores interpolate the orders with an absolute discount (Kneser-Ney): what is taken
from the seen n-grams of a context is given to the next shorter context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.tokenize import TEXTS_PER_BATCH, ByteTokenizer
from quire.session import bound_batches, materialize, ship_package

# Fixed value: the absolute discount.
DISCOUNT = 0.75


def _batch_grams(tokens: pa.Array, order: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context number, next id and row of every position of a batch of sequences."""
    offs = tokens.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    vals = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), np.diff(offs))
    at = np.arange(len(vals)) - offs[row]
    ctx = np.zeros(len(vals), dtype=np.int64)
    for k in range(order - 1, 0, -1):
        before = np.full(len(vals), begin, dtype=np.int64)
        before[k:] = vals[:len(vals) - k] if k else vals
        ctx = ctx * (begin + 1) + np.where(at >= k, before, begin)
    return ctx, vals, row


def gram_counts(df: DataFrame, order: int, vocab_size: int, tokens_col: str = "tokens",
                group_cols: list[str] | None = None, text_col: str | None = None,
                tokenizer=None) -> DataFrame:
    """``(group..., ctx, next, cnt)`` of the highest order, pre-aggregated per batch.

    With ``text_col`` the text is tokenized (and ended) in the same pass.
    """
    if order < 1 or (vocab_size + 1) ** order >= 2**63:
        raise ValueError(f"order {order} over {vocab_size} ids does not fit 64 bits")
    g, tok = list(group_cols or []), tokenizer or ByteTokenizer()
    spark = df.sparkSession
    ship_package(spark)
    bound_batches(spark, TEXTS_PER_BATCH)
    src = text_col or tokens_col
    given = df.select(*g, src)
    schema = T.StructType([f for f in given.schema.fields if f.name in g] + [
        T.StructField("ctx", T.LongType()), T.StructField("next", T.IntegerType()),
        T.StructField("cnt", T.LongType())])

    def run(batches):
        for b in batches:
            column = b.column(len(g))
            tokens = tok.encode_arrow(column, True, "ordinary") if text_col else column
            ctx, nxt, row = _batch_grams(tokens, order, vocab_size)
            of = [b.column(k).dictionary_encode() for k in range(len(g))]
            group = np.zeros(len(row), dtype=np.int64)
            for d in of:
                group = group * len(d.dictionary) + d.indices.to_numpy()[row]
            gram = ctx * (vocab_size + 1) + nxt          # the n-gram as one number
            for this in np.unique(group):
                mine = group == this
                found, n = np.unique(gram[mine], return_counts=True)
                where = pa.array(np.full(len(found), row[np.argmax(mine)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).take(where) for k in range(len(g))]
                    + [pa.array(found // (vocab_size + 1)),
                       pa.array((found % (vocab_size + 1)).astype(np.int32)),
                       pa.array(n.astype(np.int64))], names=[*g, "ctx", "next", "cnt"])

    return given.mapInArrow(run, schema).groupBy(*g, "ctx", "next").agg(F.sum("cnt").alias("cnt"))


def continuation_counts(grams: DataFrame, order: int, vocab_size: int) -> dict[int, DataFrame]:
    """``{n: (ctx, next, cnt)}``: the given counts for ``order``, continuation counts below."""
    out = {order: materialize(grams.select("ctx", "next", "cnt"), f"grams-{order}")}
    for n in range(order - 1, 0, -1):
        shorter = F.col("ctx") % F.lit((vocab_size + 1) ** (n - 1))
        out[n] = materialize(out[n + 1].groupBy(shorter.alias("ctx"), "next").agg(
            F.count(F.lit(1)).alias("cnt")), f"grams-{n}")
    return out


def suffix_counts(grams: DataFrame, order: int, vocab_size: int) -> dict[int, DataFrame]:
    """``{context length: (ctx, next, cnt)}``: how often each id followed each suffix."""
    out = {order - 1: grams.select("ctx", "next", "cnt")}
    for length in range(order - 2, -1, -1):
        shorter = F.col("ctx") % F.lit((vocab_size + 1) ** length)
        out[length] = out[length + 1].groupBy(shorter.alias("ctx"), "next").agg(
            F.sum("cnt").alias("cnt"))
    return out


def gram_logprob(counts: dict[int, DataFrame], grams: DataFrame, vocab_size: int,
                 discount: float = DISCOUNT) -> DataFrame:
    """``grams(ctx, next, ...)`` of the highest order with ``logp``, by all orders' counts."""
    out, p = grams, F.lit(1.0 / vocab_size)
    for n in sorted(counts):
        ctx = F.col("ctx") % F.lit((vocab_size + 1) ** (n - 1))
        seen = counts[n].select(F.col("ctx").alias("_sc"), F.col("next").alias("_sn"),
                                F.col("cnt").alias(f"_c{n}"))
        totals = counts[n].groupBy(F.col("ctx").alias("_tc")).agg(
            F.sum("cnt").alias(f"_t{n}"), F.count(F.lit(1)).alias(f"_k{n}"))
        out = (out.join(seen, (ctx == F.col("_sc")) & (F.col("next") == F.col("_sn")), "left")
               .drop("_sc", "_sn").join(totals, ctx == F.col("_tc"), "left").drop("_tc"))
        total = F.col(f"_t{n}").cast("double")
        mine = F.greatest(F.coalesce(F.col(f"_c{n}"), F.lit(0)) - F.lit(discount), F.lit(0.0))
        p = F.when(total.isNull(), p).otherwise(
            mine / total + discount * F.col(f"_k{n}") / total * p)
    return out.select(*grams.columns, F.log(p).alias("logp"))


def backoff_eval_loss(counts: dict[int, DataFrame], grams: DataFrame, vocab_size: int,
                      group_cols: list[str], discount: float = DISCOUNT) -> DataFrame:
    """Mean negative log-likelihood per id of ``grams(group..., ctx, next, cnt)``, per group."""
    scored = gram_logprob(counts, grams, vocab_size, discount)
    return scored.groupBy(*group_cols).agg(
        F.sum("cnt").cast("bigint").alias("n_tokens"),
        (-F.sum(F.col("cnt") * F.col("logp")) / F.sum("cnt")).alias("loss"))
