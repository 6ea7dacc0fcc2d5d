"""G6 with a model that stays distributed, and generation from longer contexts.

All live rows take their next id together: a step joins each row's context to a table
that has one row per context (its ids, cumulative weights and the weight of every other
id) and draws there.  Nothing of the model passes through the driver and no part of it
need fit in one executor; a context's row is bounded by the vocabulary.  Contexts that
many rows share at a time are salted on both sides of the join.

Several tables give a back-off: the row of the longest suffix that was seen decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import md5_uniform
from quire.session import materialize

# Steps between two writes of the rows, and copies of a hot context's row.
CHUNK, SALTS = 8, 16
# A context is hot from this share of the live rows on.
HOT_SHARE = 1 / 64
# Tables of draw rows up to this size, as measured, go to every executor; larger ones are joined
# by shuffles.
SMALL_BYTES = 32 << 20


def _cumulated(weighted: DataFrame, vocab_size: int) -> DataFrame:
    """``(ctx, next, w, other)`` -> one draw row per context: ids, ends, other, whole."""
    w = Window.partitionBy("ctx").orderBy("next")
    gap = F.col("next") - F.coalesce(F.lag("next").over(w), F.lit(-1)) - 1
    ends = weighted.withColumn("gap", gap).withColumn(
        "end", F.sum(F.col("w") + F.col("gap") * F.col("other")).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = ends.groupBy("ctx").agg(
        F.sort_array(F.collect_list(F.struct("next", "end"))).alias("r"),
        F.first("other").alias("other"))
    last = F.get("r", F.size("r") - 1)
    return rows.select(
        "ctx", F.col("r.next").alias("ids"), F.col("r.end").alias("ends"), "other",
        (last["end"] + (vocab_size - 1 - last["next"]) * F.col("other")).alias("whole"))


def bigram_draws(counts: DataFrame, vocab_size: int, temperature: float = 1.0,
                 top_k: int | None = None) -> DataFrame:
    """Draw rows of the add-one bigram model ``counts(prev, next, cnt)``, any vocabulary.

    With ``top_k`` only ids at or above the k-th largest weight can be drawn, ties
    included, unseen ids among them where fewer than k were seen.
    """
    of = Window.partitionBy("prev")
    total = F.sum("cnt").over(of) + vocab_size
    z = F.log((F.col("cnt") + 1.0) / F.col("total")) / temperature
    rows = counts.withColumn("total", total).withColumn("z", z)
    rows = rows.withColumns({
        "top": F.max("z").over(of), "rest": F.log(1.0 / F.col("total")) / temperature,
        "seen": F.count(F.lit(1)).over(of),
        "rank": F.rank().over(of.orderBy(F.desc("z")))})
    other = F.exp(F.col("rest") - F.col("top"))
    if top_k is not None and top_k < vocab_size:
        rows = rows.where(F.col("rank") <= top_k)
        other = F.when(F.col("seen") >= top_k, F.lit(0.0)).otherwise(other)
    return _cumulated(rows.select(
        F.col("prev").cast("long").alias("ctx"), "next",
        F.exp(F.col("z") - F.col("top")).alias("w"), other.alias("other")), vocab_size)


def seen_draws(grams: DataFrame, vocab_size: int) -> DataFrame:
    """Draw rows of ``grams(ctx, next, cnt)`` in proportion to the counts; unseen ids never."""
    return _cumulated(grams.select("ctx", "next", F.col("cnt").cast("double").alias("w"),
                                   F.lit(0.0).alias("other")), vocab_size)


def context_code(tokens: Column, length: int, vocab_size: int) -> Column:
    """The last ``length`` ids as one number; NULL where there are fewer."""
    code = F.lit(0).cast("long")
    for k in range(length, 0, -1):
        code = code * (vocab_size + 1) + F.get(tokens, F.size(tokens) - k).cast("long")
    return F.when(F.size(tokens) >= length, code)


def _drawn(ids: Column, ends: Column, other: Column, whole: Column, u: Column,
           vocab_size: int) -> Column:
    """The id whose stretch of the cumulative weights holds ``u * whole``."""
    steps = [1 << k for k in reversed(range(vocab_size.bit_length()))]
    n, target = F.size(ids), u * whole
    start = F.struct(F.lit(0).alias("at"), n.alias("n"), ends.alias("ends"),
                     target.alias("target"))
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), start,
        lambda s, step: F.struct(
            (s["at"] + F.when((s["at"] + step <= s["n"])
                              & (F.get(s["ends"], s["at"] + step - 1) <= s["target"]), step)
             .otherwise(F.lit(0))).alias("at"),
            s["n"].alias("n"), s["ends"].alias("ends"), s["target"].alias("target")),
        lambda s: s["at"])
    before = F.when(at > 0, F.get(ends, at - 1)).otherwise(F.lit(0.0))
    first = F.when(at > 0, F.get(ids, at - 1)).otherwise(F.lit(-1)) + 1
    limit = F.when(at < n, F.get(ids, at)).otherwise(F.lit(vocab_size - 1))
    gap = first + F.floor((target - before) / other)
    return F.when(other > 0, F.least(gap, limit.cast("long"))).otherwise(
        F.get(ids, F.least(at, n - 1)).cast("long")).cast("int")


def _hot(rows: DataFrame, ctx: Column) -> list[int]:
    """Contexts that a large share of the live rows have now (at most 1 / HOT_SHARE)."""
    live = rows.where(~F.col("done") & ctx.isNotNull())
    n = live.count()
    return [r["c"] for r in live.groupBy(ctx.alias("c")).count()
            .where(F.col("count") >= HOT_SHARE * n).collect()] if n > 10_000 else []


def _table_bytes(draws: DataFrame) -> int:
    """What draw rows take in memory: an id and an end an entry, some words a row."""
    return draws.agg(F.sum(F.size("ids") * 12 + 64)).first()[0] or 0


def generate_by_steps(prompts: DataFrame, key_col: str, tables: list[tuple[int, DataFrame]],
                      vocab_size: int, tokens_col: str = "prompt_tokens",
                      max_new_tokens: int = 200, stop_id: int | None = None, seed: int = 1234,
                      out_col: str = "generated", chunk: int = CHUNK) -> DataFrame:
    """Add ``generated`` to every prompt, drawing from distributed draw rows.

    ``tables``: ``(context length, draw rows)``, longest first; a row draws from the first
    that knows its last ids.  If none does, every id is as likely.  Draws use the uniform
    ``md5(seed:key:step)``, so the result is that of ``generate`` with the same model, for
    any partitioning.  Rows are written every ``chunk`` steps.  A table measured at no more
    than ``SMALL_BYTES`` is broadcast, any other salted and shuffled.
    """
    longest = max(n for n, _ in tables)
    empty = F.coalesce(F.col(tokens_col), F.array().cast("array<int>"))
    last = F.when(F.size(empty) > longest, F.slice(empty, -max(longest, 1), max(longest, 1))) \
        .otherwise(empty)
    if longest == 1:  # as in ``generate``: an empty prompt continues id 0
        last = F.when(F.size(last) == 0, F.array(F.lit(0))).otherwise(last)
    rows = materialize(prompts.select(
        F.col(key_col).alias("_key"), last.alias("_last"),
        F.array().cast("array<int>").alias(out_col), F.lit(False).alias("done")), "steps")
    tables = [(n, materialize(t, f"draws-{n}")) for n, t in tables]
    small = {n for n, t in tables if n == 0 or _table_bytes(t) <= SMALL_BYTES}
    for first in range(0, max_new_tokens, chunk):
        hot = {n: None if n in small else
               _hot(rows, context_code(F.col("_last"), n, vocab_size)) for n, _ in tables}
        for step in range(first, min(first + chunk, max_new_tokens)):
            rows = _step(rows, tables, hot, vocab_size, seed, step, stop_id, longest, out_col)
        rows = materialize(rows, "steps")
        if rows.where(~F.col("done")).isEmpty():
            break
    return prompts.join(rows.select(F.col("_key").alias(key_col), out_col), key_col)


def _step(rows, tables, hot, vocab_size, seed, step, stop_id, longest, out_col):
    pick = F.floor(F.col("_u") * vocab_size).cast("int")
    out = rows.withColumn("_u", md5_uniform(seed, "_key", F.lit(step)))
    for n, table in reversed(tables):
        named = table.select(*[F.col(c).alias(f"{c}{n}")
                               for c in ("ctx", "ids", "ends", "other", "whole")])
        ctx = F.when(~F.col("done"), context_code(F.col("_last"), n, vocab_size))
        if hot[n] is None:  # measured, or one row of at most the vocabulary's size
            out = out.join(F.broadcast(named), ctx == F.col(f"ctx{n}"), "left")
        else:
            many = F.lit(False)
            for code in hot[n]:
                many = many | (F.col(f"ctx{n}") == code)
            salted = named.withColumn(f"salt{n}", F.explode(F.when(
                many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
            out = out.withColumn("_c", ctx)
            is_hot = F.col("_c").isin(hot[n]) if hot[n] else F.lit(False)
            out = out.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64("_key", F.lit(step)),
                                                             F.lit(SALTS)).cast("int"))
                                 .otherwise(F.lit(0)))
            out = out.join(salted, (F.col("_c") == F.col(f"ctx{n}"))
                           & (F.col("_s") == F.col(f"salt{n}")), "left")
        pick = F.when(F.col(f"whole{n}").isNotNull(), _drawn(
            *[F.col(f"{c}{n}") for c in ("ids", "ends", "other", "whole")], F.col("_u"),
            vocab_size)).otherwise(pick)
    out = out.select("_key", "_last", out_col, "done", F.when(~F.col("done"), pick).alias("_p"))
    more = F.concat("_last", F.array("_p"))
    keep = max(longest, 1)
    stopped = F.col("done") if stop_id is None else F.col("done") | (F.col("_p") == stop_id)
    live = F.col("_p").isNotNull()
    return out.select(
        "_key", F.when(live, F.when(F.size(more) > keep, F.slice(more, -keep, keep))
                       .otherwise(more)).otherwise(F.col("_last")).alias("_last"),
        F.when(live, F.concat(out_col, F.array("_p"))).otherwise(F.col(out_col)).alias(out_col),
        F.coalesce(stopped, F.col("done")).alias("done"))
