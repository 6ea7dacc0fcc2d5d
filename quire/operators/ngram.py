"""M2/M1/A4/A5: a bigram next-token model fitted and scored with joins.

M2 stands in for the reference's GPU training loop so that scoring and
generation have a distributable model; it is NOT equivalent to the GPT.

* fit: adjacent pairs are counted in stretches of ``COUNT_TOKENS`` tokens with NumPy
  (on ``prev * V + next``), then summed with ``groupBy(prev, next)``: the shuffle is
  bounded by ``tasks * distinct pairs`` instead of tokens.  ``token_pairs``
  (``explode(arrays_zip(t[:-1], t[1:]))``) is the pure-SQL form.
* logit / log-probability with add-one smoothing: ``log((c + 1) / (t_prev + V))``.
* scoring pre-aggregates the scored pairs too, then joins the two count
  tables; both have at most V^2 rows, which bounds the broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_PAIRS = 4_000_000
# Tokens that a task counts at a time.
COUNT_TOKENS = 1 << 20


def token_pairs(df: DataFrame, tokens_col: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """One row per adjacent ``(prev, next)`` inside each sequence."""
    t = F.col(tokens_col)
    n = F.size(t)
    z = F.arrays_zip(F.slice(t, 1, n - 1).alias("prev"), F.slice(t, 2, n - 1).alias("next"))
    keep = keep or []
    return (df.where(n >= 2).select(*keep, F.explode(z).alias("_pair"))
            .select(*keep, F.col("_pair.prev").alias("prev"), F.col("_pair.next").alias("next")))


def _batch_pair_counts(tokens: pa.Array, groups: list[pa.Array]):
    """Distinct (group..., prev, next) with counts of some sequences (NumPy), a stretch at a time."""
    offs = tokens.offsets.to_numpy()
    rel = (offs - offs[0]).astype(np.int64)
    flat = tokens.flatten().to_numpy(zero_copy_only=False)
    if len(flat) < 2:
        return
    row_g, gvals = None, []
    if groups:
        keys = list(zip(*[g.to_pylist() for g in groups]))
        gvals = sorted(set(keys), key=repr)
        pos = {k: i for i, k in enumerate(gvals)}
        row_g = np.array([pos[k] for k in keys], dtype=np.int64)
    for a in range(0, len(flat) - 1, COUNT_TOKENS):
        b = min(a + COUNT_TOKENS, len(flat) - 1)      # pairs that begin at a .. b
        vals = flat[a: b + 1].astype(np.int64)
        valid = np.ones(b - a, dtype=bool)
        starts = rel[np.searchsorted(rel, a + 1): np.searchsorted(rel, b, side="right")]
        valid[starts - 1 - a] = False                 # no pair across two sequences
        v = int(vals.max()) + 1
        code, wide = vals[:-1] * v + vals[1:], v * v
        if groups:
            first = np.searchsorted(rel, a, side="right") - 1
            last = np.searchsorted(rel, b - 1, side="right")
            edges = np.clip(rel[first: last + 1], a, b)
            code += np.repeat(row_g[first:last], np.diff(edges)) * wide
        code = code[valid]
        if not len(code):
            continue
        if wide * max(1, len(gvals)) <= COUNT_TOKENS:
            cnt = np.bincount(code)
            u = np.flatnonzero(cnt)
            cnt = cnt[u]
        else:
            u, cnt = np.unique(code, return_counts=True)
        yield u % wide // v, u % v, cnt, u // wide if groups else None, gvals


def _row_slices(col: pa.Array):
    """``(first row, rows)`` stretches of ``col`` that hold about ``COUNT_TOKENS`` values."""
    rel = col.offsets.to_numpy().astype(np.int64) if pa.types.is_list(col.type) \
        else np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy())])
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(rel, rel[a] + COUNT_TOKENS, side="right")) - 1)
        yield a, b - a
        a = b


def token_pair_counts(df: DataFrame, tokens_col: str = "tokens", group_cols: list[str] | None = None,
                      text_col: str | None = None, tokenizer=None) -> DataFrame:
    """``(group..., prev, next, cnt)`` pre-aggregated per Arrow batch, then summed.

    The map side reduces each stretch of ``COUNT_TOKENS`` tokens to its distinct pairs with
    NumPy, whatever the batch or the longest text, and Spark sums those of a task before
    the shuffle.  With ``text_col`` the text is tokenized in the same pass and no token
    column is ever materialised.
    """
    from quire.operators.tokenize import TEXTS_PER_BATCH, ByteTokenizer
    from quire.session import bound_batches, ship_package, trim_memory

    g = list(group_cols or [])
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession, TEXTS_PER_BATCH)
    tok = tokenizer or ByteTokenizer()
    src = text_col or tokens_col
    in_df = df.select(*g, src)
    fields = [f for f in in_df.schema.fields if f.name in g]
    out_schema = T.StructType(fields + [T.StructField("prev", T.IntegerType(), False),
                                        T.StructField("next", T.IntegerType(), False),
                                        T.StructField("cnt", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            for at, n in _row_slices(batch.column(batch.schema.get_field_index(src))):
                b = batch.slice(at, n)
                col = b.column(b.schema.get_field_index(src))
                toks = tok.encode_arrow(col, True, "ordinary") if text_col else col
                found = _batch_pair_counts(
                    toks, [b.column(b.schema.get_field_index(c)) for c in g])
                for prev, nxt, cnt, gidx, gvals in found:
                    cols = [pa.array([gvals[i][j] for i in gidx], type=b.schema.field(f.name).type)
                            for j, f in enumerate(fields)]
                    cols += [pa.array(prev.astype(np.int32)), pa.array(nxt.astype(np.int32)),
                             pa.array(cnt.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                        [b.schema.field(f.name) for f in fields] +
                        [pa.field("prev", pa.int32(), False), pa.field("next", pa.int32(), False),
                         pa.field("cnt", pa.int64(), False)]))
        trim_memory()

    partial = in_df.mapInArrow(run, out_schema)
    return partial.groupBy(*g, "prev", "next").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def fit_ngram(df: DataFrame, tokens_col: str = "tokens", text_col: str | None = None,
              tokenizer=None) -> DataFrame:
    """M2: ``(prev, next, cnt)`` bigram counts over the sequences of ``df``."""
    return token_pair_counts(df, tokens_col, None, text_col, tokenizer)


def _maybe_broadcast(df: DataFrame, vocab_size: int) -> DataFrame:
    return F.broadcast(df) if vocab_size * vocab_size <= MAX_BROADCAST_PAIRS else df


def pair_logprob(counts: DataFrame, pairs: DataFrame, vocab_size: int) -> DataFrame:
    """Attach ``logp = log((c+1)/(t_prev+V))`` to rows with ``prev``/``next``."""
    totals = counts.groupBy("prev").agg(F.sum("cnt").alias("t_prev"))
    j = (pairs.join(_maybe_broadcast(counts, vocab_size), ["prev", "next"], "left")
         .join(_maybe_broadcast(totals, vocab_size), ["prev"], "left"))
    c = F.coalesce(F.col("cnt"), F.lit(0))
    tot = F.coalesce(F.col("t_prev"), F.lit(0))
    return j.withColumn("logp", F.log((c + 1) / (tot + F.lit(vocab_size)).cast("double")))


def ngram_eval_loss(counts: DataFrame, seqs: DataFrame, vocab_size: int,
                    group_cols: list[str] | None = None, tokens_col: str = "tokens",
                    text_col: str | None = None, tokenizer=None) -> DataFrame:
    """Token-level mean NLL of ``seqs`` under the bigram model, per ``group_cols``."""
    g = group_cols or []
    scored_pairs = token_pair_counts(seqs, tokens_col, g, text_col, tokenizer) \
        .withColumnRenamed("cnt", "m")
    lp = pair_logprob(counts, scored_pairs, vocab_size)
    return lp.groupBy(*g).agg(
        F.sum("m").cast("bigint").alias("n_pairs"),
        (-F.sum(F.col("m") * F.col("logp")) / F.sum("m")).alias("loss"))


def score_windows(counts: DataFrame, windows: DataFrame, vocab_size: int,
                  key_cols: list[str]) -> DataFrame:
    """M1: per-position NLL of next-token windows ``(key..., x, y)`` under the bigram model."""
    pos = windows.select(*key_cols, F.posexplode(F.arrays_zip("x", "y")).alias("pos", "_xy")) \
        .select(*key_cols, "pos", F.col("_xy.x").alias("prev"), F.col("_xy.y").alias("next"))
    return pair_logprob(counts, pos, vocab_size).select(*key_cols, "pos", (-F.col("logp")).alias("nll"))


def eval_loss(scored: DataFrame, split_col: str = "split", batch_col: str = "batch_id",
              nll_col: str = "nll") -> DataFrame:
    """A4: mean over batches of the per-batch mean loss (a mean of means), per split."""
    per_batch = scored.groupBy(split_col, batch_col).agg(F.avg(nll_col).alias("batch_loss"))
    return per_batch.groupBy(split_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_batches"), F.avg("batch_loss").alias("loss"))


def score_with_model(windows: DataFrame, model_fn, key_cols: list[str], block_size: int,
                     x_col: str = "x", y_col: str = "y", batch_size: int = 64) -> DataFrame:
    """M1 with a user model: per-window mean NLL via ``predict_batch_udf``.

    ``model_fn`` is a zero-argument factory, called once per Python worker, that
    returns ``predict(x: ndarray[rows, B], y: ndarray[rows, B]) -> ndarray[rows]``
    (the mean masked NLL of each window; targets ``-1`` are ignored by the model).
    """
    from pyspark.ml.functions import predict_batch_udf

    from quire.session import ship_package

    ship_package(windows.sparkSession)

    def make_predict():
        predict = model_fn()

        def run(x, y):
            return np.asarray(predict(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)),
                              dtype=np.float64)
        return run

    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[block_size], [block_size]])
    return windows.select(*key_cols, udf(F.col(x_col), F.col(y_col)).alias("nll"))
