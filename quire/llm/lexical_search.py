"""Ranked lexical search: MaxScore with bounds of term pairs.

The score of a document is a sum of whole-number impacts, one for each query term it
holds.  The index keeps documents in blocks of ``BLOCK``; a block has its postings
(term, document, impact), each term's greatest impact and, for the term pairs of the
queries, the intersection list of the block reduced to the greatest joint impact of a
document that holds both terms.

At query time a pair counts with the greatest of its joint impact and its terms' own,
which is never more than the sum of the two maxima and often less (terms that never meet
in the block count once).  The pairs are taken in order of bound.  As soon as the
bounds of the rest are below the query's threshold no further document can enter; a
block whose bounds together stay below it is not touched at all.  The threshold is the
50th best score found so far, first in a tenth of the blocks, then in the task's own.

A skipped document has a score below 50 others: skipping never changes the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.llm.shingles import byte_runs
from quire.session import materialize

#: Documents of a block; the blocks that set the first thresholds (one of so many).
BLOCK, SEED_BLOCKS = 1024, 10
#: Queries are taken in groups of about so many terms, which bounds what a task is sent.
GROUP_TERMS = 200_000

_TERM = np.zeros(256, dtype=bool)
_TERM[0x80:] = True
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: Columns of a block and the width each is kept in (a place is below ``BLOCK``).
_COLUMNS = {"docs": "<i8", "terms": "<i4", "ends": "<i4", "places": "<u2", "impacts": "<i8",
            "most": "<i8", "pairs": "<i4", "joint": "<i8"}
_INDEX = "block long, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def terms_of(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's terms in order: runs of ASCII letters and digits and of
    all other characters from U+0080 on, A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return byte_runs(text.encode("utf-8", "surrogatepass").lower(), _TERM)


def _query_terms(batches):
    for batch in batches:
        items, terms = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.unique(terms_of(text.as_py()))
            items += [item] * len(found)
            terms.append(found.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()),
             pa.array(np.concatenate(terms) if terms else [], pa.int64())],
            names=["item_id", "term"])


def _counted(vocabulary: np.ndarray):
    """(doc_id, text) -> its number of terms and how often it holds each query term."""
    def run(batches):
        for batch in batches:
            out = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not len(found):
                    continue
                at = np.searchsorted(vocabulary, found)
                at[at == len(vocabulary)] = 0
                held, times = np.unique(at[vocabulary[at] == found], return_counts=True)
                for column, x in zip(out, (doc_id, len(found), held.astype("<i4").tobytes(),
                                           times.astype("<i4").tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(),
                                                      pa.binary()))],
                names=["doc_id", "n", "terms", "times"])
    return run


def _document_frequencies(n_terms: int):
    """(terms) -> (term, df), summed over the whole task: it holds one number a term."""
    def run(batches):
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            total += np.bincount(held, minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_pairs(queries: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, list]:
    """The pairs to index, and of each query the pairs and single terms it is made of.

    A query's terms stand by weight and neighbours are paired, so that rare terms, which
    seldom meet, are bounded together; queries with the same neighbours share the pair.
    """
    pairs: dict[tuple[int, int], int] = {}
    plans = []
    for terms in queries:
        order = terms[np.lexsort((terms, -weights[terms]))].tolist()
        own = [pairs.setdefault((min(x), max(x)), len(pairs))
               for x in zip(order[::2], order[1::2])]
        plans.append((np.array(own, np.int64), np.array(order[len(order) // 2 * 2:], np.int64)))
    return np.array(sorted(pairs, key=pairs.get), np.int64).reshape(-1, 2), plans


def _joint(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, pairs: np.ndarray,
           by_first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that some document holds both terms of, and their greatest joint impact."""
    key = doc * width + term  # ascending: a posting is found by its document and term
    lo = np.searchsorted(pairs[by_first, 0], term, side="left")
    hi = np.searchsorted(pairs[by_first, 0], term, side="right")
    n = hi - lo
    source = np.repeat(np.arange(len(term)), n)
    pair = by_first[np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    other = doc[source] * width + pairs[pair, 1]
    at = np.searchsorted(key, other)
    at[at == len(key)] = 0
    both = key[at] == other if len(key) else np.zeros(0, bool)
    pair, total = pair[both], impact[source[both]] + impact[at[both]]
    most = np.zeros(len(pairs), np.int64)
    np.maximum.at(most, pair, total)
    held = np.unique(pair)
    return held, most[held]


def _index_block(docs: list, n: np.ndarray, terms: list[bytes], times: list[bytes],
                 weights: np.ndarray, pairs: np.ndarray, by_first: np.ndarray, n_docs: int,
                 n_terms: int) -> dict:
    held = [np.frombuffer(x, "<i4") for x in terms]
    doc = np.repeat(np.arange(len(docs)), [len(x) for x in held])
    term = np.concatenate(held).astype(np.int64) if held else np.empty(0, np.int64)
    tf = np.frombuffer(b"".join(times), "<i4").astype(np.int64)
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    pair, joint = _joint(doc, term, impact, pairs, by_first, len(weights))
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    own, first = np.unique(term, return_index=True)
    return {"docs": np.array(docs, np.int64), "terms": own,
            "ends": np.append(first[1:], len(term)), "places": doc, "impacts": impact,
            "most": np.maximum.reduceat(impact, first) if len(first) else impact,
            "pairs": pair, "joint": joint}


def _index(weights: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int):
    """Counted documents -> one row per block of the index."""
    by_first = np.argsort(pairs[:, 0], kind="stable")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                docs, terms, times = (part.column(c).to_pylist()
                                      for c in ("doc_id", "terms", "times"))
                made = _index_block(docs, part.column("n").to_numpy(), terms, times, weights,
                                    pairs, by_first, n_docs, n_terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id")[0].as_py()], pa.int64())]
                    + [pa.array([made[c].astype(kind).tobytes()], pa.binary())
                       for c, kind in _COLUMNS.items()], names=["block", *_COLUMNS])
    return run


class _Block:
    def __init__(self, row: dict):
        for name, kind in _COLUMNS.items():
            setattr(self, name, np.frombuffer(row[name], kind).astype(np.int64))
        self.starts = np.append(0, self.ends[:-1])

    def bounds(self, pairs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest impact of every term, bound of every pair, and terms' places here."""
        most = np.zeros(width + 1, np.int64)
        most[self.terms] = self.most
        place = np.full(width + 1, -1, np.int64)
        place[self.terms] = np.arange(len(self.terms))
        bound = np.maximum(most[pairs[:, 0]], most[pairs[:, 1]])
        bound[self.pairs] = np.maximum(bound[self.pairs], self.joint)
        return most, bound, place

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        """Add the impacts of the terms at these places to the documents' scores."""
        places = places[places >= 0]
        n = self.ends[places] - self.starts[places]
        at = np.arange(int(n.sum())) + np.repeat(self.starts[places] - (np.cumsum(n) - n), n)
        np.add.at(scores, self.places[at], self.impacts[at])


def _search(plans: list, pairs: np.ndarray, width: int, thresholds: np.ndarray, k: int):
    """Index blocks -> (query, doc_id, score): the best of this task, none surely beaten."""
    def run(batches):
        least = thresholds.copy()
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in plans]
        for batch in batches:
            for r in range(batch.num_rows):
                block = _Block({c: batch.column(c)[r].as_py() for c in batch.schema.names})
                most, bound, place = block.bounds(pairs, width)
                for q, (own, single) in enumerate(plans):
                    limit = np.concatenate([bound[own], most[single]])
                    if limit.sum() < max(least[q], 1):
                        continue
                    members = np.concatenate([pairs[own], np.stack(
                        [single, np.full(len(single), width)], axis=1)])
                    order = np.argsort(-limit, kind="stable")
                    rest = limit[order][::-1].cumsum()[::-1]  # from this pair on
                    open_ = int((rest >= max(least[q], 1)).sum())
                    scores = np.zeros(len(block.docs), np.int64)
                    block.add(place[members[order[:open_]].ravel()], scores)
                    after = rest[open_] if open_ < len(rest) else 0
                    alive = np.flatnonzero((scores > 0) & (scores + after >= least[q]))
                    if not len(alive):
                        continue
                    if after:
                        block.add(place[members[order[open_:]].ravel()], scores)
                        alive = alive[scores[alive] >= least[q]]
                    best[q].append((block.docs[alive], scores[alive]))
                    if sum(len(d) for d, _ in best[q]) > 4 * k:
                        _cut(best, least, q, k)
        out = []
        for q in range(len(plans)):
            _cut(best, least, q, k)
            out += [(q, d, s) for d, s in best[q]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(d), q) for q, d, _ in out] or [[]]), pa.int32()),
             pa.array(np.concatenate([d for _, d, _ in out] or [[]]), pa.int64()),
             pa.array(np.concatenate([s for _, _, s in out] or [[]]), pa.int64())],
            names=["query", "doc_id", "score"])
    return run


def _cut(best: list, least: np.ndarray, q: int, k: int) -> None:
    """Keep a query's ``k`` best documents so far; the k-th is its new threshold."""
    if not best[q]:
        return
    docs = np.concatenate([d for d, _ in best[q]])
    scores = np.concatenate([s for _, s in best[q]])
    order = np.lexsort((docs, -scores))[:k]
    best[q] = [(docs[order], scores[order])]
    if len(order) == k:
        least[q] = max(least[q], scores[order[-1]])


def _groups(sizes: list[tuple[int, int]]):
    """Runs of items that hold about ``GROUP_TERMS`` terms together."""
    run, held = [], 0
    for item, n in sizes:
        if run and held + n > GROUP_TERMS:
            yield run
            run, held = [], 0
        run.append(item)
        held += n
    if run:
        yield run


def _search_group(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``search`` for items whose terms fit in memory together."""
    spark = docs.sparkSession
    held: dict[int, list[int]] = {}
    for r in asked.collect():
        held.setdefault(r["item_id"], []).append(r["term"])
    items = sorted(held)
    vocabulary = np.unique(np.array([t for ts in held.values() for t in ts],
                                    np.int64).view(np.uint64))
    queries = [np.searchsorted(vocabulary, np.sort(np.array(held[i], np.int64).view(np.uint64)))
               for i in items]
    counted = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
        .mapInArrow(_counted(vocabulary), "doc_id long, n long, terms binary, times binary")
        .withColumn("id", F.monotonically_increasing_id()), "counted")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs = total["docs"]
    weights = np.full(len(vocabulary), term_weight(n_docs, 0), np.int64)
    for r in counted.select("terms").mapInArrow(
            _document_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        weights[r["term"]] = term_weight(n_docs, r["df"])
    pairs, plans = query_pairs(queries, weights)
    # a null doc_id has no name to rank by: it counts in N and L but is never returned
    index = materialize(counted.where("doc_id IS NOT NULL").mapInArrow(
        _index(weights, pairs, n_docs, total["terms"]), _INDEX), "index")

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    schema = "query int, doc_id long, score long"
    thresholds = np.ones(len(items), np.int64)
    seeds = index.where(F.pmod(F.xxhash64("block"), F.lit(SEED_BLOCKS)) == 0).mapInArrow(
        _search(plans, pairs, len(vocabulary), thresholds, k), schema)
    for r in seeds.withColumn("rank", rank).where(F.col("rank") == k).collect():
        thresholds[r["query"]] = r["score"]
    found = index.mapInArrow(_search(plans, pairs, len(vocabulary), thresholds, k), schema)
    named = spark.createDataFrame(list(enumerate(items)), "query int, item_id long")
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, *, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents of score above 0.

    Terms: runs of ASCII letters and digits and of all characters from U+0080 on, A-Z
    lower-cased.  With N documents of one term at least, L terms in all, n in a document,
    df documents holding a term and tf of it here: w = floor(1000 ln((2N+2)/(2df+1))),
    m = 50 + (50 n N) div L, and a document's score sums w * ((10^9 tf) div (1000 tf +
    20 m)) over the item's terms, once each.  Equal scores: the smaller doc_id first.

    Null and blank texts hold no term.  Rows of one item_id are one item with all their
    terms, a null item_id is left out.  Every document row counts for itself, also a
    repeated one; a row with a null doc_id counts in N, L and df but cannot be
    returned.  Other columns are ignored; no items or no documents give no rows.
    """
    spark = docs.sparkSession
    asked = materialize(
        items.select(F.col("item_id").cast("long").alias("item_id"),
                     F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
        .mapInArrow(_query_terms, "item_id long, term long").distinct(), "query-terms")
    sizes = asked.groupBy("item_id").count().orderBy("item_id")
    out = None
    for group in _groups((r["item_id"], r["count"]) for r in sizes.toLocalIterator()):
        some = asked.where(F.col("item_id").between(group[0], group[-1]))
        found = _search_group(docs, some, k)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
