"""W1 P7 P8 W6 W7 W2 W3-W5 against the flat stream built in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.offsets import stream_offsets, token_budget
from quire.operators.pack import pack_blocks
from quire.operators.sample import sample_windows
from quire.functions.hashing import md5_bigint  # noqa: F401  (documents the draw)


def _seqs(seed=7, n=60, giant=3000):
    rnd = random.Random(seed)
    out = []
    ids = rnd.sample(range(10_000), n)  # non-contiguous ids
    for k, i in enumerate(sorted(ids)):
        ln = giant if k == 17 else rnd.randint(1, 90)
        split = "val" if rnd.random() < 0.2 else "train"
        out.append((i, split, [rnd.randint(0, 256) for _ in range(ln)]))
    return out


def _df(spark, seqs, parts=5):
    df = spark.createDataFrame(seqs, "doc_id long, split string, tokens array<int>")
    return df.withColumn("n_tokens", F.size("tokens")).repartition(parts)


def _flat(seqs, split):
    out = []
    for _i, s, t in sorted(seqs):
        if s == split:
            out.extend(t)
    return out


@pytest.mark.parametrize("nb", [1, 3, 17])
def test_stream_offsets_any_bucket_count(spark, nb):
    seqs = _seqs()
    got = {r["doc_id"]: r["start"] for r in
           stream_offsets(_df(spark, seqs), "doc_id", n_buckets=nb).collect()}
    pos = {"train": 0, "val": 0}
    for i, s, t in sorted(seqs):
        assert got[i] == pos[s]
        pos[s] += len(t)


@pytest.mark.parametrize("budget", [0, 1, 500, 10**9])
def test_token_budget_keeps_crossing_row(spark, budget):
    seqs = _seqs()
    kept = sorted(r["doc_id"] for r in token_budget(_df(spark, seqs), budget, "doc_id").collect())
    want, total = [], 0
    for i, _s, t in sorted(seqs):
        want.append(i)
        total += len(t)
        if total >= budget:
            break
    assert kept == want
    assert token_budget(_df(spark, seqs), 0, "doc_id", zero_is_unlimited=True).count() == len(seqs)


@pytest.mark.parametrize("block", [8, 64])
def test_pack_blocks_equal_flat_slices(spark, block):
    seqs = _seqs()
    offs = stream_offsets(_df(spark, seqs), "doc_id", n_buckets=4)
    got = {(r["split"], r["block_id"]): r["tokens"] for r in pack_blocks(offs, block).collect()}
    for split in ("train", "val"):
        flat = _flat(seqs, split)
        nblocks = (len(flat) - 1) // block if flat else 0
        for k in range(nblocks):
            assert got.pop((split, k)) == flat[k * block: k * block + block + 1]
    assert not got


def test_pack_label_blocks(spark):
    seqs = _seqs(3, 30, 200)
    data = [(i, s, t, [x - 1 for x in t]) for i, s, t in seqs]
    df = spark.createDataFrame(data, "doc_id long, split string, tokens array<int>, labels array<int>")
    df = df.withColumn("n_tokens", F.size("tokens"))
    offs = stream_offsets(df, "doc_id")
    got = {(r["split"], r["block_id"]): (r["tokens"], r["labels"]) for r in
           pack_blocks(offs, 16, labels_col="labels").collect()}
    flat = _flat(seqs, "train")
    for k in range(len(flat) // 16):
        x, y = got[("train", k)]
        assert x == flat[16 * k: 16 * k + 16]
        assert y == [v - 1 for v in x]


def test_sample_windows_equal_slices_and_partition_invariant(spark):
    seqs = _seqs()
    train = [s for s in seqs if s[1] == "train"]
    flat = _flat(seqs, "train")
    offs = stream_offsets(_df(spark, train), "doc_id")
    a = sample_windows(offs, 40, 32, seed=5, world_size=2, batch_size=4)
    b = sample_windows(offs.repartition(7), 40, 32, seed=5, world_size=2, batch_size=4)
    ra = sorted((r["rank"], r["sample_id"], r["start"], tuple(r["window"]), r["batch_id"])
                for r in a.collect())
    rb = sorted((r["rank"], r["sample_id"], r["start"], tuple(r["window"]), r["batch_id"])
                for r in b.collect())
    assert ra == rb and len(ra) == 80
    for rank, sid, start, win, batch in ra:
        assert 0 <= start < len(flat) - 33
        assert list(win) == flat[start: start + 33]
        assert batch == sid // 4
    xy = a.select("window", "x", "y").first()
    assert xy["x"] == xy["window"][:-1] and xy["y"] == xy["window"][1:]


def test_sample_windows_needs_block_plus_two(spark):
    df = spark.createDataFrame([(1, "train", list(range(9)))], "doc_id long, split string, tokens array<int>")
    df = stream_offsets(df.withColumn("n_tokens", F.size("tokens")), "doc_id")
    with pytest.raises(Exception):
        sample_windows(df, 3, 8).collect()          # N = B+1: no valid start
    df2 = spark.createDataFrame([(1, "train", list(range(10)))], "doc_id long, split string, tokens array<int>")
    df2 = stream_offsets(df2.withColumn("n_tokens", F.size("tokens")), "doc_id")
    starts = {r["start"] for r in sample_windows(df2, 5, 8).collect()}
    assert starts == {0}                              # N = B+2: exactly one start


@pytest.mark.parametrize("block,parts", [(8, None), (30, 3)])
def test_local_and_shuffle_packing_agree(spark, block, parts):
    seqs = _seqs(11, 80, 700)
    offs = stream_offsets(_df(spark, seqs), "doc_id", n_buckets=5)
    if parts:
        offs = offs.repartition(parts)
    for partial in (False, True):
        a = sorted((r["split"], r["block_id"], tuple(r["tokens"])) for r in
                   pack_blocks(offs, block, keep_partial=partial, method="shuffle").collect())
        b = sorted((r["split"], r["block_id"], tuple(r["tokens"])) for r in
                   pack_blocks(offs, block, keep_partial=partial, method="local").collect())
        assert a == b


def test_split_is_partition_invariant_and_matches_md5(spark):
    import hashlib

    from quire.operators.split import assign_split

    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = dict(assign_split(df, fraction=0.1).collect())
    b = dict(assign_split(df.repartition(13), fraction=0.1).collect())
    assert a == b
    for i in range(0, 2000, 97):
        u = int(hashlib.md5(f"1337:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert a[i] == ("val" if u < 0.1 else "train")
    assert 120 < sum(v == "val" for v in a.values()) < 280
