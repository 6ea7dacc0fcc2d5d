"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (1 to 3
letters, words padded) in rank order.  A document's own most frequent n-grams are
ranked the same way and compared with every profile by the out-of-place distance:
the sum of rank differences, ``PROFILE`` for an n-gram the profile lacks.

Profiles are fitted on at most about ``SAMPLE`` documents of each language, chosen
by a hash of doc_id; every document is predicted from its whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import bound_batches, trim_memory

#: Texts that go to a Python worker at a time.
TEXTS_PER_BATCH = 1000
PROFILE = 300
SAMPLE = 4000
UNKNOWN = "und"
_SALTS = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a letter, 0 for a word's edge) and their counts."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
    if not codes.any():
        return none, none
    codes = np.concatenate([[0], codes, [0]])
    edge = codes == 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    codes = codes[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    grams = np.concatenate([
        b[inner], (codes[:-1] << 21) | codes[1:] | (1 << 62),
        ((a[inner] << 42) | (b[inner] << 21) | c[inner]) | (1 << 61)])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent ``PROFILE`` n-grams, ties by value."""
    if len(grams) > PROFILE:  # all that can be among them, ties included
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def _count(batches):
    """(lang, text) -> (lang, gram, n), summed within the batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        per: dict[str, list] = {}
        for lang, text in zip(langs, batch.column(1)):
            per.setdefault(lang, []).append(ngrams(text.as_py()))
        out = []
        for lang, found in per.items():
            grams = np.concatenate([g for g, _ in found])
            counts = np.concatenate([c for _, c in found])
            distinct, at = np.unique(grams, return_inverse=True)
            total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
            out.append((lang, distinct, total))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for lang, g, _ in out for x in [lang] * len(g)], pa.string()),
             pa.array(np.concatenate([g for _, g, _ in out]) if out else [], pa.int64()),
             pa.array(np.concatenate([n for _, _, n in out]) if out else [], pa.int64())],
            names=["lang", "gram", "n"])


def fit_profiles(labelled: DataFrame, *, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles of ``labelled(doc_id, lang, text)``; rows with a null lang or text are left out.

    Only per-language counts and at most ``_SALTS * PROFILE`` n-grams a language reach
    the driver.  Languages without a letter in their sample have no profile.
    """
    bound_batches(labelled.sparkSession, TEXTS_PER_BATCH)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items()
                           for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.lit("profile"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    counts = (rows.where(draw < share[F.col("lang")]).select("lang", "text")
              .mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(_SALTS))).orderBy(
        F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(salted)).where(
        F.col("rank") <= PROFILE).select("lang", "gram", "n").collect()
    per: dict[str, list] = {}
    for r in best:
        per.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {lang: [g for _, g in sorted(found)[:PROFILE]] for lang, found in sorted(per.items())}


class _Comparer:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array(
            [g for lang in self.langs for g in profiles[lang]], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64))
            self.ranks[at, k] = np.arange(len(at))

    def best(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        top = _ranked(grams, counts)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, PROFILE,
                         np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        k = int(np.argmin(apart))
        return self.langs[k], 1.0 - float(apart[k]) / (PROFILE * len(top))


def predict_language(text: Column, profiles: dict[str, list[int]]) -> Column:
    """``struct<lang_pred, score>``: nearest profile, 1 - distance / greatest distance.

    Null texts, texts without a letter and an empty set of profiles give ``und`` and 0;
    equal distances go to the language first in order.
    """
    def predict(texts: pd.Series) -> pd.DataFrame:
        comparer = _Comparer(profiles)
        found = [comparer.best(t) for t in texts]
        trim_memory()
        return pd.DataFrame({"lang_pred": [x for x, _ in found],
                             "score": [s for _, s in found]})

    return F.pandas_udf(predict, "lang_pred string, score double")(text)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(F.col(column).cast("string")) % folds


def identify_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from rows of folds other than 2 of 4; a null doc_id is neither held out nor
    learned from.  Repeated rows count and are predicted as often as they occur.
    """
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    profiles = fit_profiles(docs.where(fold("doc_id", 4) != 2))
    found = predict_language(F.col("text").cast("string"), profiles)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                        found.alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score"))
