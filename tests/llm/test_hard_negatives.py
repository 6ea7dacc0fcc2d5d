"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

import quire.llm.hard_negatives as hard

COLUMNS = "vec_id long, label int, embedding array<float>, rank int, a long, score string"


def clipped(score):
    return max(1 - 2**63, min(2**63 - 1, score))


def brute(rows, is_anchor, scale=256, low=80, high=100):
    usable = []
    for v, label, e in rows:
        if v is None or label is None or not e or any(
                x is None or not math.isfinite(x) for x in e):
            continue
        usable.append((v, label, [math.floor(scale * x) for x in e]))
    out = []
    for r, (a, label, e) in enumerate(usable):
        if not is_anchor(a):
            continue
        scored = [(-clipped(sum(p * q for p, q in zip(e, o[2]))), o[0], o[1])
                  for s, o in enumerate(usable) if s != r and len(o[2]) == len(e)]
        scored.sort()
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label
                      and -low * ps <= -100 * x[0] <= -high * ps]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(window[:5])]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], COLUMNS).repartition(3)
    found = hard.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                             "negative_score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda v: v % 10 == 0, **kw)


def clustered(n, dim=6, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(k, rnd.randrange(3), [float(np.float32(c + rnd.gauss(0, 0.3)))
                                   for c in rnd.choice(centres)]) for k in range(n)]


def test_bands_blocks_and_clusters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard, "FIRST", 32)
    monkeypatch.setattr(hard, "GROWTH", 3)
    monkeypatch.setattr(hard, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard, "MEMBERS", 8)
    monkeypatch.setattr(hard, "PER_CLUSTER", 9)
    check(spark, clustered(500))


def test_one_list_walked_in_a_single_band(spark):
    check(spark, clustered(120, seed=4))


def test_null_zero_huge_repeated_and_unlike_vectors(spark):
    rows = clustered(60, dim=3, seed=2)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, [1.0, 0.0, 0.0]), (110, 1, None), (120, 1, [1.0, None, 0.0]),
             (130, 1, [nan, 0.0, 1.0]), (140, 1, [inf, 0.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]),
             (150, 1, []), (160, 1, [0.0, 0.0, 0.0]), (161, 2, [0.0, 0.0, 0.0]),
             (170, 1, [1.0, 2.0]), (171, 1, [1.0, 2.0]), (172, 2, [1.0, 1.5]),
             (180, 0, [3e7, -1e7, 2e7]), (181, 0, [2e7, 1e7, 2e7]), (182, 1, [2e7, 0.0, 2e7])]
    rows += [rows[0], rows[0], rows[10], rows[3]]
    check(spark, rows)


def test_ties_and_equal_vectors(spark):
    rows = [(k, k % 2, [0.5, 0.5]) for k in range(70)] + [(k, k % 3, [0.25, 0.25]) for k in range(70, 90)]
    check(spark, rows)


def test_no_rows_and_no_anchors(spark):
    check(spark, [])
    check(spark, [(1, 0, [1.0]), (2, 1, [1.0])])


def test_wide_and_narrow_windows(spark):
    check(spark, clustered(80, seed=7), low=0, high=100)
    check(spark, clustered(80, seed=8), low=95, high=99)
