"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; everything else is
unlabelled web text.  A logistic score over thresholded shape measures and hashed words
and letter triples of the whole text minimises the non-negative unbiased risk
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``, so no negative label is
ever read.  The class prior is estimated from the same two samples: a probe tells positives
from unlabelled text, and over rows it did not see the prior is the least ratio, over the
probe's thresholds, of the unlabelled share above to the positive share above.  Where the
purest unlabelled rows are nearly all positive, that ratio is the prior.

The model is fitted on at most ``POSITIVES`` + ``UNLABELLED`` rows taken by a hash of
doc_id (``LIMIT`` times that at the very most reach the driver, as ``WIDTH`` four-byte
numbers each); every document is scored from its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.langid import fold
from quire.llm.quality_rules import Text
from quire.llm.shingles import mix64, word_hashes

POSITIVES = 8000
UNLABELLED = 12000
LIMIT = 2
QUANTILES = (.01, .02, .05, .1, .2, .35, .5, .65, .8, .9, .95, .98, .99)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


# each is a share or a mean, so that the length of a text alone says little
MEASURES = (
    ("symbols", lambda t: _share(t.n_symbols, t.n_words)),
    ("exclamations", lambda t: _share(t.text.count("!"), t.n_words)),
    ("capitals", lambda t: _share(t.cased[0], t.cased[1])),
    ("repeated_words", lambda t: _share(t.n_repeat_words, t.n_words)),
    ("repeated_lines", lambda t: _share(t.n_dup_lines, len(t.lines))),
    ("distinct_words", lambda t: _share(len(set(t.words)), t.n_words)),
    ("word_length", lambda t: _share(t.word_chars, t.n_words)),
    ("letters", lambda t: _share(t.cased[1], t.word_chars)),
    ("stops", lambda t: _share(t.text.count(".") + t.text.count(","), t.n_words)),
    ("lines", lambda t: _share(len(t.lines), t.n_words)),
    ("digits", lambda t: _share(sum(t.data.count(b"%d" % d) for d in range(10)), t.word_chars)),
    ("words", lambda t: float(np.log1p(t.n_words))),
)


#: Buckets for words and, after them, for triples of bytes.
BUCKETS = 256
SHAPES = len(MEASURES)
WIDTH = SHAPES + 2 * BUCKETS
SLICE = 1 << 20
ROWS = 512


def _counted(hashes: np.ndarray) -> np.ndarray:
    sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
    return np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), weights=sign,
                       minlength=BUCKETS)


def _unit(counts: np.ndarray) -> np.ndarray:
    """Damped counts at length 1, so that the length of a text says nothing."""
    v = np.sign(counts) * np.log1p(np.abs(counts))
    n = np.sqrt(v @ v)
    return v / n if n else v


def hashed(data: bytes) -> np.ndarray:
    """Signed bucket counts of a text's words and byte triples, without regard to case."""
    data = data.lower()
    triples = np.zeros(BUCKETS)
    for at in range(0, max(0, len(data) - 2), SLICE):      # slices share two bytes, no triple is lost
        b = np.frombuffer(data, np.uint8, min(SLICE + 2, len(data) - at), at).astype(np.uint64)
        triples += _counted(mix64(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]))
    return np.concatenate([_unit(_counted(word_hashes(data))), _unit(triples)])


def measure(text: str | None) -> np.ndarray:
    t = Text(text)
    return np.concatenate([[f(t) for _, f in MEASURES], hashed(t.data)]).astype(np.float32)


def measures(text: Column) -> Column:
    """The ``WIDTH`` numbers of a text as four-byte floats in a binary."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t).tobytes() for t in texts], dtype=object)

    return F.pandas_udf(run, "binary")(text)


@dataclass(frozen=True)
class Model:
    """``steps``: (measure, threshold) pairs; a text scores by which of them it passes and by its
    hashed words and triples (all columns after the shape measures)."""

    steps: tuple[tuple[int, float], ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.passed(x), x[:, SHAPES:]]).astype(np.float32)

    def passed(self, x: np.ndarray) -> np.ndarray:
        at = np.array([k for k, _ in self.steps], dtype=np.int64)
        return (x[:, at] > np.array([v for _, v in self.steps])).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """A row's score rests on that row alone, to the last bit: every row is summed by itself."""
        if not self.weights:
            return np.full(len(x), _sigmoid(np.float64(self.bias)))
        w = np.array(self.weights)
        return np.concatenate([
            _sigmoid((self.encode(x[at:at + ROWS]) * w).sum(axis=1) + self.bias)
            for at in range(0, len(x), ROWS)])


#: Without both samples nothing can be told.
UNFITTED = Model((), (), 0.0, 0.5)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _descend(gradient, width: int, rounds: int, rate: float = 0.1) -> np.ndarray:
    """Adam on ``width + 1`` parameters, the last one the bias."""
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    for k in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, ridge: float = 1e-3,
                   doubt: float = 0.1, margin: float = 0.01) -> float:
    """Share of positives in ``u``, cross-fitted over two halves.

    The threshold is where the ratio of shares is least after a term for the chance of
    ``doubt`` that a share strays from its expectation; thresholds few rows pass lose by it.
    """
    found = []
    for side in (0, 1):
        fp, fu = p[side::2], u[side::2]
        x = np.hstack([np.vstack([fp, fu]), np.ones((len(fp) + len(fu), 1))]).astype(np.float32)
        y = np.concatenate([np.ones(len(fp)), np.zeros(len(fu))])
        s = np.where(y == 1, 0.5 / max(1, len(fp)), 0.5 / max(1, len(fu)))
        w = _descend(lambda w: (s * (_sigmoid(x @ w.astype(np.float32)) - y)).astype(np.float32)
                     @ x + ridge * w, p.shape[1], 200)
        zp, zu = (np.sort(v[1 - side::2] @ w[:-1] + w[-1]) for v in (p, u))
        if not len(zp) or not len(zu):
            continue
        at = np.unique(zp)
        above_p = 1 - np.searchsorted(zp, at) / len(zp)
        above_u = 1 - np.searchsorted(zu, at) / len(zu)
        stray = np.sqrt(np.log(4 / doubt) / 2) * (len(zp) ** -0.5 + len(zu) ** -0.5)
        k = np.argmin((above_u + (1 + margin) * stray) / above_p)
        found.append(above_u[k] / above_p[k])
    return float(np.clip(np.mean(found), 0.05, 0.95))


def risk(w: np.ndarray, p1: np.ndarray, u1: np.ndarray, pi: float) -> tuple[float, float]:
    """The two parts of the risk of ``w`` over rows that end in 1: on positives, and on
    negatives as the unlabelled rows less the positives among them."""
    zp, zu = p1 @ w, u1 @ w
    return (float(pi * np.logaddexp(0, -zp).mean()),
            float(np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, prior: float | None = None,
        rounds: int = 400, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative risk; where its second part falls below 0, that part alone
    is stepped back, as the estimator prescribes."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return UNFITTED
    both = np.vstack([positive[:, :SHAPES], unlabelled[:, :SHAPES]])
    steps = tuple((k, float(v)) for k in range(both.shape[1])
                  for v in np.unique(np.quantile(both[:, k], QUANTILES)))
    shell = Model(steps, (), 0.0, 0.5)
    p, u = shell.encode(positive), shell.encode(unlabelled)
    pi = estimate_prior(p, u) if prior is None else prior
    p1, u1 = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (p, u))

    def gradient(w: np.ndarray) -> np.ndarray:
        v = w.astype(np.float32)
        sp, su = _sigmoid(p1 @ v), _sigmoid(u1 @ v)
        negative = su @ u1 / len(su) - pi * (sp @ p1) / len(sp)
        if risk(v, p1, u1, pi)[1] < 0:
            return -negative + ridge * w
        return pi * ((sp - 1) @ p1) / len(sp) + negative + ridge * w

    w = _descend(gradient, p1.shape[1] - 1, rounds, rate=0.05)
    return Model(steps, tuple(w[:-1].tolist()), float(w[-1]), pi)


def _draw(salt: str, share: float) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20))


def _sample(docs: DataFrame, bound: int) -> np.ndarray:
    rows = docs.select(measures(F.col("text")).alias("x")).limit(LIMIT * bound).collect()
    return np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs(doc_id, text)`` and the positives among ``labels(doc_id, quality)``.

    A doc_id is trusted when all its labels are 1.
    """
    trusted = labels.groupBy("doc_id").agg(
        F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("worst")).where("worst = 1") \
        .select("doc_id")
    n_docs, n_trusted = docs.count(), trusted.count()
    if not n_docs or not n_trusted:
        return UNFITTED
    chosen = (trusted.where(_draw("trusted", min(1.0, POSITIVES / n_trusted)))
              .limit(LIMIT * POSITIVES))  # so the broadcast is of bounded size
    positive = _sample(docs.join(F.broadcast(chosen), "doc_id"), POSITIVES)
    unlabelled = _sample(docs.where(_draw("unlabelled", min(1.0, UNLABELLED / n_docs))),
                         UNLABELLED)
    return fit(positive, unlabelled)


def quality_score(text: Column, model: Model) -> Column:
    """Probability-like score of good quality, for any text, empty and null ones too."""
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack([measure(t) for t in texts])))

    return F.pandas_udf(run, "double")(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from folds other than 1 of 3, of labels and of unlabelled text alike; a null
    doc_id is neither held out nor learned from.  Repeated rows are scored each; other columns,
    whatever their names, are ignored.
    Without documents or trusted positives every score is 0.5.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    learn = fold("doc_id", 3) != 1
    model = train(narrow.where(learn),
                  labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
                  .where(learn))
    return (narrow.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
                          .alias("held_out"), quality_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
