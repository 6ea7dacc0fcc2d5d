"""K4/K5/A1/A2 preparation reports, A7 run plan, A8 parameter summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

GIB = float(1 << 30)
# Bytes per stored token and per stored label.
TOKEN_BYTES = 2   # uint16
LABEL_BYTES = 4   # int32


def corpus_report(df: DataFrame, split_col: str = "split", len_col: str = "n_tokens",
                  max_tokens: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """K4/A1/A2: per split documents, tokens, GiB as uint16, and the run total.

    ``stopped_early`` is true when a budget was given and the total reached it.
    ``extra`` adds more aggregates to the same single pass (one partial +
    final aggregate, a tiny shuffle of one row per split and task).
    """
    aggs = [F.count(F.lit(1)).alias("n_docs"),
            F.sum(F.col(len_col).cast("bigint")).alias("n_tokens")]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    per = df.groupBy(split_col).agg(*aggs)
    total = F.sum("n_tokens").over(_all())
    out = per.select(
        split_col, "n_docs", "n_tokens",
        F.round(F.col("n_tokens") * TOKEN_BYTES / GIB, 6).alias("gib"),
        total.alias("total_tokens"), *list(extra or {}))
    if max_tokens is not None:
        out = out.withColumn("stopped_early",
                             F.lit(max_tokens > 0) & (F.col("total_tokens") >= max_tokens))
    return out


def _all():
    from pyspark.sql import Window
    return Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def observe_tokens(df: DataFrame, len_col: str = "n_tokens", name: str = "tokens"):
    """K5: progress counter as an ``Observation``; read it after the action."""
    obs = Observation(name)
    observed = df.observe(obs, F.count(F.lit(1)).alias("n_rows"),
                          F.sum(F.col(len_col).cast("bigint")).alias("n_tokens"))
    return observed, obs


def tokens_per_iter(batch_size: Column, block_size: Column, grad_accum: Column,
                    world_size: Column) -> Column:
    """``(accum // world) * world * batch * block``; accum must divide by world."""
    accum = F.when(grad_accum % world_size == 0, F.floor(grad_accum / world_size)).otherwise(
        F.raise_error(F.lit("gradient_accumulation_steps must be divisible by world_size")))
    return (accum.cast("bigint") * world_size * batch_size * block_size).cast("bigint")


def run_plan(configs: DataFrame, train_tokens: DataFrame) -> DataFrame:
    """Tokens per iteration, iterations run (cap inclusive), epochs of the corpus.

    ``train_tokens`` is a one-row table ``(n_tokens)`` computed from the corpus.
    """
    c = configs.withColumn("tokens_per_iter", tokens_per_iter(
        F.col("batch_size"), F.col("block_size"), F.col("grad_accum"), F.col("world_size")))
    c = c.withColumn("iters_run", (F.col("max_iters") + 1).cast("bigint"))
    c = c.withColumn("tokens_sampled", F.col("tokens_per_iter") * F.col("iters_run"))
    # one-row aggregate as a scalar subquery (evaluated once, inlined as a value)
    corpus = train_tokens.select(F.col("n_tokens").cast("bigint")).scalar()
    c = c.withColumn("corpus_tokens", corpus)
    return c.withColumn("epochs", F.round(F.col("tokens_sampled") / F.col("corpus_tokens"), 6))


def param_summary(params: DataFrame) -> DataFrame:
    """Per run total parameters, non-embedding count, decayed (>=2-D) vs not.

    ``params(run_id, name, shape ARRAY<INT>)``; a tied tensor is listed once.
    The position table is the parameter named ``wpe``-like via ``is_position``.
    """
    numel = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    p = params.withColumn("numel", numel).withColumn("decay", F.size("shape") >= 2)
    return p.groupBy("run_id").agg(
        F.sum("numel").alias("n_params"),
        F.sum(F.when(F.col("is_position"), 0).otherwise(F.col("numel"))).alias("n_params_non_embedding"),
        F.sum(F.when(F.col("decay"), 1).otherwise(0)).cast("bigint").alias("n_decay_tensors"),
        F.sum(F.when(F.col("decay"), F.col("numel")).otherwise(0)).alias("n_decay_params"),
        F.sum(F.when(F.col("decay"), 0).otherwise(1)).cast("bigint").alias("n_nodecay_tensors"),
        F.sum(F.when(F.col("decay"), 0).otherwise(F.col("numel"))).alias("n_nodecay_params"),
    )


def gpt_manifest(spark, run_id: int, vocab_size, block_size: int, n_layer: int, n_embd: int,
                 bias: bool = False) -> DataFrame:
    """Parameter manifest ``(run_id, name, shape, is_position)`` of the reference transformer.

    The head is tied to the token table, so it is listed once.  ``vocab_size``
    may be a Column (e.g. a scalar subquery over the tokenized corpus).
    """
    c = n_embd
    v = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    per_layer = [("ln_1.weight", [c]), ("attn.c_attn.weight", [3 * c, c]),
                 ("attn.c_proj.weight", [c, c]), ("ln_2.weight", [c]),
                 ("mlp.c_fc.weight", [4 * c, c]), ("mlp.c_proj.weight", [c, 4 * c])]
    if bias:
        per_layer += [("ln_1.bias", [c]), ("attn.c_attn.bias", [3 * c]), ("attn.c_proj.bias", [c]),
                      ("ln_2.bias", [c]), ("mlp.c_fc.bias", [4 * c]), ("mlp.c_proj.bias", [c])]
    tensors = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(x) for x in s]).alias("shape"))
                        for n, s in per_layer])
    layers = spark.range(n_layer).select(F.col("id").alias("layer"), F.explode(tensors).alias("t"))
    layers = layers.select(F.concat(F.lit("h."), F.col("layer").cast("string"), F.lit("."),
                                    F.col("t.name")).alias("name"), F.col("t.shape").alias("shape"))
    glob = [("wte.weight", F.array(v.cast("int"), F.lit(c))),
            ("wpe.weight", F.array(F.lit(block_size), F.lit(c))),
            ("ln_f.weight", F.array(F.lit(c)))]
    if bias:
        glob.append(("ln_f.bias", F.array(F.lit(c))))
    g = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), s.alias("shape")) for n, s in glob])).alias("t"))
    g = g.select("t.name", "t.shape")
    allp = layers.unionByName(g)
    return allp.select(F.lit(run_id).cast("bigint").alias("run_id"), "name", "shape",
                       (F.col("name") == "wpe.weight").alias("is_position"))
