"""Autoregressive generation over a table of prompts.

``mapInPandas`` runs the loop per Arrow batch: all rows of the batch step
together (NumPy over the batch), a row stops after appending the stop id, and
every draw uses the hash uniform ``md5(seed:row:step)``, computed on the JVM and
handed in as an array - so the output is the same for any partitioning or retry.

A model is a plug-in with ``next_logits(contexts) -> ndarray[rows, V]``, or with
``pick(last, u, temperature, top_k, greedy) -> ndarray[rows]`` when it needs only
the last id and can draw without a dense row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.hashing import md5_uniform
from quire.session import ship_package

# Pairs of a model shipped to the executors: 2^24 rows are about 200 MB.
MAX_PAIRS = 1 << 24


class BigramModel:
    """Add-one-smoothed bigram model held as its observed pairs, sorted by (prev, next).

    Pairs that were not observed all weigh the same, so a draw over the whole
    vocabulary needs only the observed ones and arithmetic on the gaps between them.
    ``kept`` is the number of most frequent pairs per ``prev`` that were retained
    (None: all): enough for greedy or top-k draws with ``top_k <= kept``.
    """

    def __init__(self, prev: np.ndarray, nxt: np.ndarray, cnt: np.ndarray, totals: dict[int, int],
                 vocab_size: int, kept: int | None = None):
        order = np.lexsort((nxt, prev))
        self.nxt, self.cnt = nxt[order].astype(np.int64), cnt[order].astype(np.float64)
        ids, first = np.unique(prev[order], return_index=True)
        ends = np.append(first[1:], len(order))
        self.rows = {int(p): (int(a), int(b)) for p, a, b in zip(ids, first, ends)}
        self.totals, self.vocab_size, self.kept = totals, vocab_size, kept
        self._tables: dict = {}

    def dense(self) -> np.ndarray:
        """Log-probabilities ``V x V``, for small vocabularies."""
        c = np.zeros((self.vocab_size, self.vocab_size))
        for p, (a, b) in self.rows.items():
            c[p, self.nxt[a:b]] = self.cnt[a:b]
        total = np.array([self.totals.get(p, 0) for p in range(self.vocab_size)], dtype=float)
        return np.log((c + 1.0) / (total[:, None] + self.vocab_size))

    def _table(self, p: int, temperature: float, top_k: int | None):
        """Ids kept at ``p``, their weights and cumulative ends, weight of any other id."""
        key = (p, temperature, top_k)
        if key in self._tables:
            return self._tables[key]
        a, b = self.rows.get(p, (0, 0))
        ids, v = self.nxt[a:b], self.vocab_size
        total = self.totals.get(p, 0) + v
        z = np.log((self.cnt[a:b] + 1.0) / total) / temperature
        rest = np.log(1.0 / total) / temperature
        top = z.max() if len(z) else rest
        k = v if top_k is None else min(top_k, v)
        if self.kept is not None and k > self.kept:
            raise ValueError(f"the model keeps {self.kept} pairs a row, top_k is {k}")
        if len(z) >= k:  # an unseen id never reaches the k-th observed one
            keep = z >= -np.sort(-z)[k - 1]
            ids, z, other = ids[keep], z[keep], 0.0
        else:
            other = float(np.exp(rest - top))
        w = np.exp(z - top)
        gaps = np.diff(ids, prepend=-1) - 1
        ends = np.cumsum(w + gaps * other)
        whole = (ends[-1] if len(ends) else 0.0) + (v - 1 - (ids[-1] if len(ids) else -1)) * other
        if len(self._tables) > 4096:
            self._tables.clear()
        self._tables[key] = ids, w, ends, other, whole
        return self._tables[key]

    def pick(self, last: np.ndarray, u: np.ndarray, temperature: float, top_k: int | None,
             greedy: bool) -> np.ndarray:
        out = np.zeros(len(last), dtype=np.int64)
        for p in np.unique(last).tolist():
            rows = np.flatnonzero(last == p)
            if greedy:
                a, b = self.rows.get(p, (0, 0))
                out[rows] = self.nxt[a + int(self.cnt[a:b].argmax())] if b > a else 0
                continue
            ids, w, ends, other, whole = self._table(p, temperature, top_k)
            target = u[rows] * whole
            at = np.searchsorted(ends, target, side="right")  # first end above the target
            seen = at < len(ids)
            k = np.minimum(at, max(0, len(ids) - 1))
            before = np.where(at > 0, ends[np.maximum(at, 1) - 1] if len(ends) else 0.0, 0.0)
            start = np.where(at > 0, ids[np.maximum(at, 1) - 1] if len(ids) else 0, -1) + 1
            if other > 0:
                gap = start + np.floor((target - before) / other).astype(np.int64)
                limit = np.where(seen, ids[k] if len(ids) else 0, self.vocab_size - 1)
                out[rows] = np.minimum(gap, limit)
            else:
                out[rows] = ids[k]
        return out


def bigram_model(counts: DataFrame, vocab_size: int, keep: int | None = None) -> BigramModel:
    """Model of ``counts(prev, next, cnt)``; with ``keep`` only each row's most frequent pairs.

    Ties at the ``keep``-th place stay.  What is shipped is at most ``vocab_size`` totals and
    ``MAX_PAIRS`` pairs; a larger model raises and needs a ``keep`` (``vocab_size * keep`` rows
    and ties): a top-k or greedy draw never looks further.
    """
    totals = {r["prev"]: int(r["t"]) for r in
              counts.groupBy("prev").agg(F.sum("cnt").alias("t")).limit(vocab_size + 1).collect()}
    if len(totals) > vocab_size or any(not 0 <= p < vocab_size for p in totals):
        raise ValueError("ids outside the vocabulary")
    pairs = counts.select("prev", "next", "cnt")
    if keep is not None:
        rank = F.rank().over(Window.partitionBy("prev").orderBy(F.desc("cnt")))
        pairs = pairs.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    pdf = pairs.limit(MAX_PAIRS + 1).toPandas()
    if len(pdf) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs: give keep (the top_k of the draws)")
    if len(pdf) and not 0 <= int(pdf["next"].min()) <= int(pdf["next"].max()) < vocab_size:
        raise ValueError("ids outside the vocabulary")
    return BigramModel(pdf["prev"].to_numpy(), pdf["next"].to_numpy(), pdf["cnt"].to_numpy(), totals,
                       vocab_size, keep)


def _draw(logits: np.ndarray, u: np.ndarray, temperature: float, top_k: int | None,
          greedy: bool) -> np.ndarray:
    if greedy:
        return logits.argmax(axis=1)
    z = logits / temperature
    w = np.exp(z - z.max(axis=1, keepdims=True))
    if top_k is not None and top_k < z.shape[1]:
        threshold = np.partition(z, z.shape[1] - top_k, axis=1)[:, z.shape[1] - top_k, None]
        w = np.where(z >= threshold, w, 0.0)
    cum = np.cumsum(w, axis=1)
    hit = cum > (u * cum[:, -1])[:, None]
    return np.where(hit.any(axis=1), hit.argmax(axis=1), (w > 0).cumsum(axis=1).argmax(axis=1))


def generate(df: DataFrame, model, key_col: str, tokens_col: str = "prompt_tokens",
             max_new_tokens: int = 200, temperature: float = 1.0, top_k: int | None = None,
             stop_id: int | None = None, seed: int = 1234, greedy: bool = False,
             block_size: int | None = None, out_col: str = "generated") -> DataFrame:
    """Add ``generated ARRAY<INT>`` (new ids only, stop id included when hit).

    ``block_size`` crops the context a ``next_logits`` model sees to its last ids.
    """
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])
    uniforms = F.array().cast("array<double>") if greedy or max_new_tokens < 1 else F.transform(
        F.sequence(F.lit(0), F.lit(max_new_tokens - 1)), lambda i: md5_uniform(seed, key_col, i))

    def run(batches):
        mdl = pickle.loads(bc.value)
        for pdf in batches:
            n = len(pdf)
            prompts = [np.asarray(t if t is not None else [], dtype=np.int64)
                       for t in pdf[tokens_col]]
            last = np.array([p[-1] if len(p) else 0 for p in prompts], dtype=np.int64)
            draws = (np.zeros((n, max_new_tokens)) if greedy or max_new_tokens < 1
                     else np.stack(pdf["_uniforms"].to_list()) if n else np.zeros((0, 1)))
            gen = np.zeros((n, max_new_tokens), dtype=np.int64)
            lens = np.zeros(n, dtype=np.int64)
            active = np.ones(n, dtype=bool)
            for step in range(max_new_tokens):
                idx = np.flatnonzero(active)
                if not len(idx):
                    break
                if hasattr(mdl, "pick"):
                    picks = mdl.pick(last[idx], draws[idx, step], temperature, top_k, greedy)
                else:
                    cur = [np.concatenate([prompts[i], gen[i, :lens[i]]]) for i in idx]
                    logits = mdl.next_logits([c[-block_size:] if block_size else c for c in cur])
                    picks = _draw(logits, draws[idx, step], temperature, top_k, greedy)
                gen[idx, step] = picks
                last[idx] = picks
                lens[idx] += 1
                if stop_id is not None:
                    active[idx[picks == stop_id]] = False
            out = pdf.drop(columns="_uniforms")
            out[out_col] = pd.Series([gen[i, :lens[i]].astype(np.int32) for i in range(n)],
                                     index=pdf.index)
            yield out

    return df.withColumn("_uniforms", uniforms).mapInPandas(run, schema)
