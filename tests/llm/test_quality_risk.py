"""The classifier's risk against a plain minimiser, its features against plain counts, and what
hashed text adds to shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality_pu as q


def plain_risk(w, p, u, pi):
    """Row by row, as the estimator is written down."""
    def loss(x, sign):
        return np.log1p(np.exp(-sign * (float(np.dot(x, w[:-1])) + w[-1])))

    on_positives = pi * np.mean([loss(x, 1) for x in p])
    negatives = np.mean([loss(x, -1) for x in u]) - pi * np.mean([loss(x, -1) for x in p])
    return on_positives, negatives


def plain_minimum(p, u, pi, ridge):
    """Subgradient descent with numeric gradients on the clamped risk."""
    def value(w):
        a, b = plain_risk(w, p, u, pi)
        return a + max(0.0, b) + ridge / 2 * float(w @ w)

    w = np.zeros(p.shape[1] + 1)
    best = value(w)
    step = 1.0
    while step > 1e-3:
        g = np.array([(value(w + h) - value(w - h)) / 2e-4 for h in 1e-4 * np.eye(len(w))])
        new = w - step * g
        if value(new) < best:
            w, best, step = new, value(new), step * 1.2
        else:
            step /= 2
    return w, best


@pytest.mark.parametrize("pi,seed", [(0.6, 1), (0.3, 2)])
def test_fitted_risk_is_that_of_a_plain_minimiser(monkeypatch, pi, seed):
    monkeypatch.setattr(q, "QUANTILES", (0.5,))
    rng = np.random.default_rng(seed)
    p = np.zeros((40, q.SHAPES), np.float32)
    u = np.zeros((60, q.SHAPES), np.float32)
    p[:, :2] = rng.normal(0.5, 1, (40, 2))
    n = int(60 * pi)
    u[:n, :2], u[n:, :2] = rng.normal(0.5, 1, (n, 2)), rng.normal(-0.5, 1, (60 - n, 2))
    ridge = 0.02
    model = q.fit(p, u, prior=pi, ridge=ridge, rounds=1500)
    w = np.array([*model.weights, model.bias])
    a, b = model.encode(p).astype(float), model.encode(u).astype(float)
    _, best = plain_minimum(a, b, pi, ridge)
    first, second = plain_risk(w, a, b, pi)
    assert first + max(0.0, second) + ridge / 2 * float(w @ w) <= best + 5e-3
    ones = (np.hstack([x, np.ones((len(x), 1))]) for x in (a, b))
    assert np.allclose(q.risk(w, *ones, pi), (first, second))


def test_hashed_counts_equal_plain_ones(monkeypatch):
    text = "Ab ab  cd\nÉab AB cd " * 7
    data = text.lower().encode() if text.isascii() else text.encode().lower()
    words, triples = np.zeros(q.BUCKETS), np.zeros(q.BUCKETS)

    def put(to, h):
        to[h % q.BUCKETS] += -1 if h >> 63 else 1

    for w in data.split():
        put(words, int(q.word_hashes(w)[0]))
    for i in range(len(data) - 2):
        put(triples, int(q.mix64(np.array([int.from_bytes(data[i:i + 3], "big")], np.uint64))[0]))
    for size in (1 << 20, 5, 1):                # slices lose no triple
        monkeypatch.setattr(q, "SLICE", size)
        got = q.hashed(text.encode())
        assert np.allclose(got, np.concatenate([q._unit(words), q._unit(triples)]))
    for short in (b"", b"a", b"ab"):
        assert q.hashed(short)[q.BUCKETS:].any() == False  # noqa: E712
    assert np.allclose(np.abs(q.hashed(b"abc")).sum(), 2)


def prose(rnd, stems, n):
    return " ".join(rnd.choice(stems) + rnd.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."


def test_fluent_rubbish_and_another_language_are_told_by_their_words(spark):
    """Same lengths, lines and punctuation; only the words differ."""
    rnd = random.Random(5)
    good = ["walk", "river", "stone", "letter", "open", "water", "garden", "listen"]
    bad = ["zirf", "plomb", "quozz", "gratz", "vurmn", "skelb", "drohp", "wunzt"]
    rows = [(k, prose(rnd, good if k % 3 else bad, rnd.randint(60, 120)), "x", 0.1, 7)
            for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, "
                                       "predicted double, quality int").repartition(3)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 1500, 2) if k % 3],
                                   "doc_id long, quality int")
    twice = docs.unionByName(docs.where("doc_id < 30"))
    out = q.score_quality(twice, labels).collect()
    assert len(out) == 1530
    by_id = {}
    for r in out:                                # repeated rows score alike
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    held = [r for r in out if r.held_out]
    right = [r.predicted == (1 if r.doc_id % 3 else 0) for r in held]
    assert np.mean(right) > 0.95
    noisy = labels.withColumn("text", F.lit("clash")).unionByName(
        spark.createDataFrame([(None, 1, ""), (4, None, "")], "doc_id long, quality int, text string"))
    assert len(q.score_quality(docs, noisy).collect()) == 1500


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_texts_that_differ_in_words(share):
    rnd = random.Random(8)
    good, bad = ["walk", "river", "stone", "water"], ["zirf", "plomb", "quozz", "vurmn"]
    n = int(800 * share)
    p = np.stack([q.measure(prose(rnd, good, rnd.randint(60, 120))) for _ in range(400)])
    u = np.stack([q.measure(prose(rnd, good if k < n else bad, rnd.randint(60, 120)))
                  for k in rnd.sample(range(800), 800)])
    assert abs(q.fit(p, u, rounds=1).prior - share) < 0.07
