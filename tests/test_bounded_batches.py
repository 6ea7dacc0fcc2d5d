"""What a Python worker holds at a time does not grow with the batch, the rows or the longest text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators.ngram import COUNT_TOKENS, _batch_pair_counts, _row_slices, fit_ngram, token_pair_counts
from quire.operators.pack import CUT_TOKENS, _RunPacker, pack_blocks
from quire.session import BATCH_BYTES

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def fresh(spark):
    """A session of its own, with Spark's default batches."""
    yield spark.newSession()
    spark.range(1).count()      # the first session is the active one again


def _bounded(session):
    return int(session.conf.get(ROWS)) <= 1000 and session.conf.get(BYTES) == f"{BATCH_BYTES}b"


def test_pairs_are_counted_in_stretches():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 2 * COUNT_TOKENS + 7, 5, 0, COUNT_TOKENS, 3])
    vals = rng.integers(0, 200, sizes.sum()).astype(np.int32)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    tokens = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals))
    groups = [pa.array([f"g{i % 2}" for i in range(len(sizes))])]
    tracemalloc.start()
    got: dict = {}
    for prev, nxt, cnt, g, names in _batch_pair_counts(tokens, groups):
        for p, n, c, k in zip(prev.tolist(), nxt.tolist(), cnt.tolist(), g.tolist()):
            key = (*names[k], p, n)
            got[key] = got.get(key, 0) + c
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want: dict = {}
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        code, cnt = np.unique(vals[a:b][:-1].astype(np.int64) * 200 + vals[a:b][1:], return_counts=True)
        for u, c in zip(code.tolist(), cnt.tolist()):
            key = (f"g{i % 2}", u // 200, u % 200)
            want[key] = want.get(key, 0) + c
    assert got == want
    assert peak < 70 * COUNT_TOKENS     # some arrays of a stretch, not of all sequences


def test_rows_of_a_stretch_cover_the_batch():
    texts = pa.array(["a" * COUNT_TOKENS, "b" * COUNT_TOKENS, None, "", "c", "d" * (COUNT_TOKENS + 1), "e"])
    cuts = list(_row_slices(texts.slice(1)))
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1].tolist()]
    assert sum(n for _, n in cuts) == 6 and len(cuts) == 4


def test_counting_bounds_its_batches(fresh):
    docs = fresh.createDataFrame([("x", "abab"), ("y", None), ("x", "ba")], "split string, text string")
    got = {(r.split, r.prev, r.next): r.cnt for r in
           token_pair_counts(docs, group_cols=["split"], text_col="text").collect()}
    assert got == {("x", 97, 98): 2, ("x", 98, 97): 2, ("x", 98, 256): 1, ("x", 97, 256): 1}
    assert _bounded(fresh)
    assert sum(r.cnt for r in fit_ngram(docs, text_col="text").collect()) == 6


def test_block_cutter_counts_what_it_holds():
    packer = _RunPacker(5, 4, 1)
    packer.extend("train", 0, [np.arange(21, dtype=np.int32)])
    assert packer.held == 25
    assert sum(a.size for *_, arrays in packer.drain() for a in arrays) == 25 and packer.held == 0


def test_local_blocks_of_a_long_sequence(fresh):
    n = CUT_TOKENS + 1234
    rows = fresh.range(3).select(
        F.lit("train").alias("split"), (F.col("id") * n).alias("start"), F.lit(n).alias("n_tokens"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: ((i * 7 + F.col("id")) % 251).cast("int"))
        .alias("tokens"))
    rows = rows.withColumn("labels", F.transform("tokens", lambda x: x - 1))

    def stats(method):
        out = pack_blocks(rows, 4096, labels_col="labels", method=method)
        return out.agg(F.count("*"), F.bit_xor(F.xxhash64("block_id", "tokens", "labels"))).first()

    assert stats("local") == stats("shuffle")
    assert _bounded(fresh)
