import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.sharding import minimax_cuts, shard_documents

SCHEMA = "doc_id long, text string, shard string, size string"


def least_capacity(sizes, n):
    """Dynamic programme over prefixes, independent of any greedy rule."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(n):
        nxt = list(best)
        for i in range(1, len(sizes) + 1):
            run = 0
            for j in range(i, 0, -1):
                run += sizes[j - 1]
                nxt[i] = min(nxt[i], max(best[j - 1], run))
        best = nxt
    return best[len(sizes)]


def groups_of(rows):
    found = {}
    for i, t in rows:
        key = ("null",) if t is None else ("text", t)
        first, size = found.get(key, (float("inf"), 0))
        found[key] = (min(first, -2**63 if i is None else i),
                      size + len((t or "").encode()) + 1)
    return found


def check(rows, out, n):
    assert len(out) == len(rows)
    found = groups_of(rows)
    by_text = {}
    for r in out:
        by_text.setdefault(r.shard, []).append(r)
    sizes = [s for _, s in sorted(found.values())]
    loads = [sum(r.size for r in by_text.get(k, [])) for k in range(n)]
    assert max(loads) == least_capacity(sizes, n)
    for rs in by_text.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in out)


def test_minimax_slots_groups_and_edge_rows(spark):
    rows = [(k, "w" * (k * 37 % 50)) for k in range(40)] + [(100, None), (101, None), (102, ""),
            (None, "nobody"), (7, "twice"), (7, "twice"), (300, "é" * 90), (301, "x" * 400)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    for n in (1, 3, 16):
        out = shard_documents(docs, n).collect()
        check(rows, out, n)
        place = {}
        crc = {}
        for i, t in rows:
            crc.setdefault(i, set()).add(zlib.crc32((t or "").encode()))
        for r in out:
            assert r.text_crc32 in crc[r.doc_id]
            place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert all(len(v) == 1 for k, v in place.items() if k[1] > 1)


def test_hot_group_and_empty_table(spark):
    rows = [(k, "hot text") for k in range(30)] + [(100 + k, "t%d" % k) for k in range(20)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    check(rows, shard_documents(docs, 4).collect(), 4)
    assert shard_documents(docs.limit(0), 4).collect() == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 6))
def test_cuts_reach_the_least_capacity(spark, sizes, n):
    import quire.llm.sharding as S

    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    cells, S.CELLS = S.CELLS, 8  # forces the picture of the axis to be refined
    try:
        cuts = minimax_cuts(spark.createDataFrame(ends, "end long"), n, at, max(sizes))
    finally:
        S.CELLS = cells
    edges = [0, *cuts, at]
    assert edges == sorted(edges) and len(cuts) == n - 1
    assert all(c in {0} | {e for e, in ends} for c in cuts)
    assert max(b - a for a, b in zip(edges, edges[1:])) == least_capacity(sizes, n)
