"""Generation by distributed steps and discounted n-grams, against plain restatements."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import quire.operators.stepwise as stepwise
from quire.operators.backoff import (DISCOUNT, continuation_counts, gram_counts, gram_logprob,
                                     suffix_counts)
from quire.operators.generate import bigram_model, generate
from quire.operators.stepwise import bigram_draws, context_code, generate_by_steps, seen_draws


def pairs(spark, vocab, seed, n=400):
    rnd = random.Random(seed)
    c = Counter((rnd.randrange(12) * 7 % vocab, rnd.randrange(vocab)) for _ in range(n))
    return spark.createDataFrame([(a, b, k) for (a, b), k in c.items()],
                                 "prev int, next int, cnt long")


def prompts(spark, vocab, n=40):
    rnd = random.Random(9)
    rows = [(f"r{k}", [rnd.randrange(vocab) for _ in range(k % 4)]) for k in range(n)]
    return spark.createDataFrame(rows + [("none", None)], "key string, prompt_tokens array<int>")


@pytest.mark.parametrize("vocab,top_k,temperature", [
    (50_304, None, 1.0), (50_304, None, 0.6), (50_304, 200, 0.7), (30, None, 1.3), (30, 3, 1.0),
    (30, 30, 1.0)])
@pytest.mark.parametrize("small", [0, stepwise.SMALL_BYTES])
def test_steps_equal_the_local_model(spark, monkeypatch, vocab, top_k, temperature, small):
    monkeypatch.setattr(stepwise, "SMALL_BYTES", small)
    counts = pairs(spark, vocab, vocab % 97)
    given = prompts(spark, vocab)
    want = generate(given, bigram_model(counts, vocab), "key", max_new_tokens=10,
                    temperature=temperature, top_k=top_k, stop_id=3, seed=5)
    got = generate_by_steps(given.repartition(3), "key",
                            [(1, bigram_draws(counts, vocab, temperature, top_k))], vocab,
                            max_new_tokens=10, stop_id=3, seed=5, chunk=4)
    assert dict(got.select("key", "generated").collect()) == dict(
        want.select("key", "generated").collect())


def test_hot_contexts_are_salted_without_a_change(spark, monkeypatch):
    counts = pairs(spark, 40, 1)
    rows = spark.range(12_000).select(F.col("id").cast("string").alias("key"),
                                      F.array(F.lit(7)).alias("prompt_tokens"))
    draws = bigram_draws(counts, 40)
    kw = dict(max_new_tokens=3, seed=2, chunk=2)
    sent = generate_by_steps(rows, "key", [(1, draws)], 40, **kw).collect()     # broadcast whole
    monkeypatch.setattr(stepwise, "SMALL_BYTES", 0)
    salted = generate_by_steps(rows, "key", [(1, draws)], 40, **kw)
    assert stepwise._hot(rows.select(F.col("prompt_tokens").alias("_last"), F.lit(False).alias("done")),
                         context_code(F.col("_last"), 1, 40)) == [7]
    a = {r["key"]: r["generated"] for r in salted.collect()}
    monkeypatch.setattr(stepwise, "_hot", lambda rows, ctx: [])
    b = {r["key"]: r["generated"] for r in generate_by_steps(rows, "key", [(1, draws)], 40, **kw).collect()}
    assert a == b == {r["key"]: r["generated"] for r in sent}
    assert len(a) == 12_000 and all(len(x) == 3 for x in a.values())


SEQS = [[1, 2, 3, 1, 2, 4, 1, 2, 3], [2, 2, 2], [], [5], [1, 2, 3, 4, 5, 0]]


def grams_of(seqs, order, vocab):
    c = Counter()
    for s in seqs:
        padded = [vocab] * (order - 1) + s
        for i in range(len(s)):
            code = 0
            for x in padded[i:i + order - 1]:
                code = code * (vocab + 1) + x
            c[code, s[i]] += 1
    return c


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_gram_counts(spark, order):
    df = spark.createDataFrame([(str(k % 2), s) for k, s in enumerate(SEQS)],
                               "part string, tokens array<int>").repartition(2)
    got = {(r["ctx"], r["next"]): r["cnt"] for r in gram_counts(df, order, 6).collect()}
    assert got == grams_of(SEQS, order, 6)
    per = Counter()
    for r in gram_counts(df, order, 6, group_cols=["part"]).collect():
        per[r["part"], r["ctx"], r["next"]] += r["cnt"]
    assert per == Counter({(str(p), *k): n for p in (0, 1)
                           for k, n in grams_of(SEQS[p::2], order, 6).items()})
    assert gram_counts(df.limit(0), order, 6).collect() == []
    with pytest.raises(ValueError):
        gram_counts(df, 5, 50_304)


def test_probabilities_of_a_context_sum_to_one_and_follow_the_definition(spark):
    vocab, order = 6, 3
    df = spark.createDataFrame([(s,) for s in SEQS], "tokens array<int>")
    counts = continuation_counts(gram_counts(df, order, vocab), order, vocab)
    contexts = [(a, b) for a in range(vocab + 1) for b in range(vocab + 1)]
    rows = spark.createDataFrame([(a * 7 + b, w, 1) for a, b in contexts for w in range(vocab)],
                                 "ctx long, next int, cnt long")
    got = {(r["ctx"], r["next"]): math.exp(r["logp"])
           for r in gram_logprob(counts, rows, vocab).collect()}
    c3 = grams_of(SEQS, 3, vocab)
    c2 = Counter((ctx % 7, w) for ctx, w in c3)
    c1 = Counter((0, w) for _, w in c2)

    def p(ctx, w, n):
        if n == 0:
            return 1 / vocab
        c, key = {1: c1, 2: c2, 3: c3}[n], ctx % 7 ** (n - 1)
        own = {x: k for (y, x), k in c.items() if y == key}
        if not own:
            return p(ctx, w, n - 1)
        t = sum(own.values())
        return max(own.get(w, 0) - DISCOUNT, 0) / t + DISCOUNT * len(own) / t * p(ctx, w, n - 1)

    for a, b in contexts:
        assert abs(sum(got[a * 7 + b, w] for w in range(vocab)) - 1) < 1e-9
        for w in range(vocab):
            assert abs(got[a * 7 + b, w] - p(a * 7 + b, w, 3)) < 1e-12


@pytest.mark.parametrize("small", [0, stepwise.SMALL_BYTES])
def test_continuations_follow_the_longest_seen_suffix(spark, monkeypatch, small):
    monkeypatch.setattr(stepwise, "SMALL_BYTES", small)
    vocab = 6
    df = spark.createDataFrame([(s,) for s in SEQS], "tokens array<int>")
    suffixes = suffix_counts(gram_counts(df, 3, vocab), 3, vocab)
    draws = [(n, seen_draws(c, vocab)) for n, c in suffixes.items()]
    given = [("a", [1, 2]), ("b", [0, 2]), ("c", [4]), ("d", []), ("e", None), ("f", [9, 1, 2, 3, 4, 5])]
    rows = spark.createDataFrame(given, "key string, prompt_tokens array<int>")
    got = {r["key"]: r["generated"] for r in
           generate_by_steps(rows, "key", draws, vocab, max_new_tokens=6, seed=3).collect()}
    tables = [Counter(), Counter(), Counter()]
    for s in SEQS:
        padded = [vocab, vocab, *s]
        for i, w in enumerate(s):
            for n in range(3):
                tables[n][tuple(padded[i + 2 - n:i + 2]), w] += 1
    for key, prompt in given:
        seen = list(prompt or [])
        for step in range(6):
            for n in (2, 1, 0):
                own = sorted((w, k) for (c, w), k in tables[n].items()
                             if len(seen) >= n and c == tuple(seen[len(seen) - n:]))
                if own:
                    break
            u = int(hashlib.md5(f"3:{key}:{step}".encode()).hexdigest()[:8], 16) / 2**32
            ends = np.cumsum([k for _, k in own])
            seen.append(own[int(np.searchsorted(ends, u * ends[-1], side="right"))][0])
        assert got[key] == seen[len(prompt or []):], key
    assert len({tuple(x) for x in got.values()}) > 2
    assert generate_by_steps(rows.limit(0), "key", draws, vocab, max_new_tokens=2).collect() == []
