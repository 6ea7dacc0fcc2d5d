"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np

import quire.llm.lexical_search as lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    tfs = [(i, Counter(words(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    queries = {}
    for item, text in items:
        if item is not None:
            queries.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in queries.items():
        found = []
        for i, c in tfs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "é", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 60)))) for k in range(n)]
    items = [(k, ", ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 25))).upper())
             for k in range(12)]
    return docs, items


def check(spark, docs, items, k=7):
    d = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs],
                              "doc_id long, text string, n int, terms string, query string").repartition(4)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, term int")
    found = lexical.search(d, q, k=k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs, items, k)


def test_ranks_against_a_plain_scorer(spark):
    docs, items = corpus(900, 1)
    check(spark, docs, items)


def test_odd_rows_ties_and_copies(spark):
    docs, items = corpus(60, 2)
    docs += [(70, None), (71, ""), (72, " ,;! "), (None, "w1 w2 zebra"), (73, "w5 " * 3000)]
    docs += [(k, "Zebra zebra W1") for k in range(80, 120)] + [docs[3], docs[3], (3, "zebra é")]
    items += [(20, None), (21, ""), (22, "zebra"), (22, "W7 w1"), (None, "w1"), (23, "unseen"),
              (24, "w1"), (24, "w1"), (25, "é Über")]
    check(spark, docs, items)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_TERMS", 20)
    docs, items = corpus(120, 3)
    check(spark, docs, items, k=3)


def test_empty_tables(spark):
    docs, items = corpus(5, 4)
    check(spark, [], items)
    check(spark, docs, [])
    check(spark, [(1, None)], items)


def test_pair_bounds_hold_and_tighten():
    """A pair's bound is never below a joint score and never above the sum of the maxima."""
    rnd = np.random.default_rng(5)
    weights = rnd.integers(100, 5000, 12)
    pairs = np.array([(0, 1), (2, 3), (4, 5), (6, 7)])
    held = [np.sort(rnd.choice(12, rnd.integers(1, 8), replace=False)) for _ in range(40)]
    times = [rnd.integers(1, 4, len(x)) for x in held]
    n = np.array([x.sum() for x in times])
    made = lexical._index_block(
        list(range(40)), n, [x.astype("<i4").tobytes() for x in held],
        [x.astype("<i4").tobytes() for x in times], weights, pairs,
        np.argsort(pairs[:, 0], kind="stable"), 40, int(n.sum()))
    block = lexical._Block({c: made[c].astype(k).tobytes() for c, k in lexical._COLUMNS.items()})
    most, bound, place = block.bounds(pairs, 12)
    score = np.zeros((12, 40), np.int64)
    for t in range(12):
        block.add(place[[t]], score[t])
    for (a, b), limit in zip(pairs, bound):
        assert limit == (score[a] + score[b]).max()
        assert limit <= most[a] + most[b]
    assert (bound < most[pairs[:, 0]] + most[pairs[:, 1]]).any()
