"""Components, MinHash near-duplicates and embedding links against brute force."""

import random

import numpy as np
import pytest

import quire.llm.minhash_paths as paths
from quire.llm.components import connected_components
from quire.llm.embedding_dedup import embedding_near_duplicates, same_cell, tables_needed
from quire.llm.shingles import jaccard_counts, permutation_constants, shingle_set, signature

DOCS = "doc_id long, text string, kept string, group string, v long, component_id string"


def joined(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    edges += [(b, a) for a, b in edges[:20]] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "a long, b long")
    real = [(a, b) for a, b in edges if a != b]
    want = joined({n for e in real for n in e}, real)
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def words(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            .translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets.setdefault(i, []).append({tuple(w[x:x + k]) for x in range(len(w) - k + 1)} if w else set())
    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    edges = [(i, j) for x, (i, s) in enumerate(flat) for j, t in flat[:x]
             if 100 * len(s & t) >= 75 * len(s | t)]
    return sets, joined({i for i in sets if i is not None}, edges)


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "a", "b", 9, "c") for i, t in rows], DOCS).repartition(3)
    out = paths.minhash_near_duplicates(docs, **kw).collect()
    sets, want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.component_id == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def edited(rnd, base, n):
    w = list(base)
    for _ in range(n):
        w[rnd.randrange(len(w))] = "x%d" % rnd.randrange(10**6)
    return " ".join(w)


def corpus(rnd):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
            (None, "one two"), (None, None), (7, "É a b c d e"), (8, "é a b c d e"),
            (9, "q r s t u v"), (10, "long " * 30_000)]
    passage = ["p%d" % k for k in range(30)]
    for g in range(6):
        base = ["w%d_%d" % (g, rnd.randrange(60)) for _ in range(80)]
        for _ in range(8):
            rows.append((100 + len(rows), edited(rnd, base, rnd.randrange(0, 5))))
    for _ in range(40):  # unlike documents that share a passage
        rows.append((100 + len(rows), " ".join(
            passage + ["u%d" % rnd.randrange(10**6) for _ in range(60)])))
    rows += [(rows[20][0] + 1000, rows[20][1]), (rows[20][0], rows[20][1]), (rows[25][0], rows[40][1])]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    check(spark, corpus(random.Random(1)))


@pytest.mark.parametrize("exhaust,depth", [(4096, 8), (12, 8), (12, 1)])
def test_hot_nodes_blocks_and_branches(spark, monkeypatch, exhaust, depth):
    monkeypatch.setattr(paths, "EXHAUST", exhaust)
    monkeypatch.setattr(paths, "BLOCK", 8)
    monkeypatch.setattr(paths, "CENTRES", 2)
    monkeypatch.setattr(paths, "MAX_DEPTH", depth)
    check(spark, corpus(random.Random(2)), leaf=6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_texts_of_an_id_below_hot_nodes(spark, monkeypatch, seed):
    """Ids with two unlike texts lose no link, though one text's nodes are small and the other's hot."""
    for name, value in (("EXHAUST", 12), ("BLOCK", 8), ("CENTRES", 2)):
        monkeypatch.setattr(paths, name, value)
    rnd = random.Random(seed)
    passage = ["p%d" % k for k in range(60)]
    rows = [(k, " ".join(passage + ["u%d" % rnd.randrange(10**6) for _ in range(25)]))
            for k in range(40)]
    for k in range(12):
        base = passage + ["b%d_%d" % (k, j) for j in range(40)]
        rows += [(100 + k, " ".join(base)), (200 + k, edited(rnd, base, 1))]
        rows.append((200 + k, " ".join("o%d" % rnd.randrange(10**6) for _ in range(60))))
    check(spark, rows, leaf=6)


def test_rows_are_judged_by_id_and_text(spark):
    rnd = random.Random(7)
    a = ["a%d" % k for k in range(80)]
    near, other, repeat = edited(rnd, a, 1), "q " + " ".join(a[::-1]), "r s t u v w"
    rows = [(5, " ".join(a)), (9, near), (9, other), (7, repeat), (7, repeat), (8, repeat),
            (None, near), (None, "n o p q r"), (1, None), (1, None), (2, ""), (2, ""), (3, " \t")]
    docs = spark.createDataFrame([(i, t, "a", "b", 9, "c") for i, t in rows], DOCS).repartition(3)
    out = paths.deduplicated(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert kept == sorted([(5, " ".join(a)), (9, other), (7, repeat), (None, "n o p q r"),
                           (1, None), (1, None), (2, ""), (2, ""), (3, " \t")], key=repr)
    assert paths.deduplicated(docs.limit(0)).collect() == []


def test_empty_table(spark):
    assert paths.minhash_near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_minwise_agreement_and_exact_counts():
    rnd = random.Random(3)
    a = shingle_set(" ".join("a%d" % rnd.randrange(10**6) for _ in range(300)))
    b = np.unique(np.concatenate([a[:200], shingle_set(" ".join("b%d" % k for k in range(104)))]))
    inter, union = jaccard_counts(a, b)
    assert (inter, union) == (len(np.intersect1d(a, b)), len(np.union1d(a, b)))
    mul, add = permutation_constants(4000, 1)
    agree = (signature(a, mul, add) == signature(b, mul, add)).mean()
    assert abs(agree - inter / union) < 0.04


def links(rows, threshold):
    found = {}
    for i, lab, e in rows:
        ok = e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
        found.setdefault(i, [])
        if ok and lab is not None and i is not None and (lab, tuple(e)) not in found[i]:
            found[i].append((lab, tuple(e)))
    flat = [(i, lab, np.array(e, dtype=float)) for i, ee in found.items() for lab, e in ee]
    edges = [(i, j) for x, (i, a, e) in enumerate(flat) for j, b, f in flat[:x]
             if i != j and a == b and len(e) == len(f)
             and e @ f / np.sqrt((e @ e) * (f @ f)) >= threshold]
    n = {i: sum(i in e for e in edges) for i in found}
    return n, joined({i for i in found if i is not None}, edges)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, bad = [], [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8,
                     [float("inf")] * 8]
    for g in range(30):
        base = rng.standard_normal(8)
        for _ in range(12):
            v = base + rng.standard_normal(8) * rng.uniform(0, 0.5)
            rows.append((len(rows), int(g % 3), [float(x) for x in v * rng.uniform(0.1, 1e3)]))
    rows += [(1000 + k, 1, b) for k, b in enumerate(bad)]
    rows += [(2000, None, rows[0][2]), (None, 0, rows[0][2]), (2001, 0, rows[0][2][:7]), rows[5],
             (2002, 0, rows[3][2])]
    df = spark.createDataFrame([(i, lab, e, "x", 1) for i, lab, e in rows],
                               "vec_id long, label int, embedding array<double>, n string, row long")
    out = embedding_near_duplicates(df.repartition(4)).collect()
    n, want = links(rows, 0.93)
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == (n[r.vec_id], want[r.vec_id]), r
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_near_duplicates(df.limit(0)).collect() == []


def test_hot_cell_is_dealt_in_blocks(spark, monkeypatch):
    import quire.llm.embedding_dedup as E

    monkeypatch.setattr(E, "BLOCK", 7)
    rng = np.random.default_rng(9)
    base = rng.standard_normal(6)
    rows = [(k, 0, [float(x) for x in base + 0.02 * rng.standard_normal(6)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    out = embedding_near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(59, 0)}


def test_equal_vectors_are_counted_not_compared(spark):
    rng = np.random.default_rng(3)
    same = [float(x) for x in rng.standard_normal(6)]
    near = [x * 1.5 + 0.001 for x in same]
    rows = [(k, 0, same) for k in range(20_000)] + [(30_000 + k, 0, near) for k in range(3)]
    rows += [(40_000 + k, 1, same) for k in range(2)] + [(5, 0, near), (6, 1, same)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = {}
    for r in embedding_near_duplicates(df.repartition(4)).collect():
        out.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    # the copies of label 0, the near vectors, and 5's second vector
    assert out[9] == (20_003, 0, False) and out[0] == (20_003, 0, True)
    assert out[30_001] == (20_003, 0, False)
    assert out[5] == (20_002 + 20_002, 0, False)
    assert out[6] == (20_003 + 2, 0, False) and out[40_000] == (2, 0, False)


def test_table_plan():
    p = same_cell(np.sqrt(2 - 2 * 0.93)) ** 8
    assert (1 - p) ** tables_needed(0.93, 8) <= 1e-4
    assert same_cell(0.0) == 1.0 and same_cell(0.2) > same_cell(1.4)


def test_trees_reach_their_recall_at_full_depth():
    from quire.llm.minhash_paths import BRANCHING, MAX_DEPTH, N_ROOTS

    child = 1 - (1 - 0.75) ** BRANCHING
    assert (1 - 0.75 * child ** MAX_DEPTH) ** N_ROOTS < 1e-5
