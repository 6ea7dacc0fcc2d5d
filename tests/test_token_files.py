"""S3 ranges and random access, versioned manifests, streaming and continuing writers."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quire.operators.sample import sample_windows, windows_from_files
from quire.operators.offsets import stream_offsets
from quire.plans.prepare import continue_corpus, prepare_corpus
from quire.session import scratch_path
from quire.sources.tokenbin import (TokenFiles, read_token_range, read_token_splits,
                                    read_token_stream, stream_state, write_token_stream)
from quire.streaming.ingest import LiveCounter, file_stream, stage_in_order, stream_tokenize
from quire.streaming.token_files import TokenFileSink, stream_token_files


def local(path):
    return path.removeprefix("file:")


def flat(spark, path):
    rows = sorted(read_token_stream(spark, path).collect(), key=lambda r: r["offset"])
    return [t for r in rows for t in r["tokens"]]


@pytest.fixture
def written(spark):
    rnd = random.Random(3)
    rows, at = [], 0
    for _ in range(300):
        n = rnd.randint(1, 60)
        rows.append((at, [rnd.randint(0, 65535) for _ in range(n)]))
        at += n
    path = scratch_path(spark, "t-files")
    write_token_stream(spark.createDataFrame(rows, "start long, tokens array<int>").repartition(5),
                       path, n_parts=5)
    # several parts: the stream written in three appends
    half = [(at + k * 7, list(range(7))) for k in range(40)]
    write_token_stream(spark.createDataFrame(half, "start long, tokens array<int>"), path,
                       mode="append")
    tail = [(at + 280, [9] * 500)]
    write_token_stream(spark.createDataFrame(tail, "start long, tokens array<int>"), path,
                       mode="append")
    return path, [t for _, x in rows for t in x] + list(range(7)) * 40 + [9] * 500


def test_ranges_are_pushed_into_the_scan(spark, written):
    path, want = written
    n = len(want)
    for first, end in ((0, n), (5, 6), (100, 4000), (n - 3, n + 50), (n, n + 5), (70, 70)):
        for row_tokens in (7, 64):
            rows = sorted(read_token_range(spark, path, first, end, row_tokens).collect())
            assert [t for r in rows for t in r["tokens"]] == want[first:end]
            assert all(want[r["offset"]:r["offset"] + len(r["tokens"])] == r["tokens"] for r in rows)
    # parts outside the range are not even opened
    parts = stream_state(path)["parts"]
    os.remove(f"{local(path)}/{parts[-1]['file']}")
    assert [t for r in sorted(read_token_range(spark, path, 10, 200, 16).collect())
            for t in r["tokens"]] == want[10:200]
    with pytest.raises(Exception, match="part-"):
        read_token_range(spark, path, n - 10, n, 16).collect()


def test_every_comparison_of_the_offset_gives_the_rows_spark_gives(spark, written):
    path, _ = written
    whole = {r["offset"] for r in read_token_stream(spark, path, row_tokens=50).collect()}
    some = sorted(whole)[len(whole) // 2]
    for test, keep in (("offset > {}", lambda o: o > some), ("offset >= {}", lambda o: o >= some),
                       ("offset < {}", lambda o: o < some), ("offset <= {}", lambda o: o <= some),
                       ("offset = {}", lambda o: o == some), ("offset <> {}", lambda o: o != some)):
        got = {r["offset"] for r in read_token_stream(spark, path, row_tokens=50)
               .where(test.format(some)).collect()}
        assert got == {o for o in whole if keep(o)}


def test_windows_from_files_equal_slices_and_sampled_windows(spark, written):
    path, want = written
    got = windows_from_files(spark, path, 60, 32, seed=5, world_size=2, batch_size=4).collect()
    assert len(got) == 120
    for r in got:
        assert r["window"] == want[r["start"]:r["start"] + 33]
        assert r["x"] == r["window"][:-1] and r["y"] == r["window"][1:]
        assert r["batch_id"] == r["sample_id"] // 4
    table = spark.createDataFrame([(1, "train", want)], "doc_id long, split string, tokens array<int>")
    offs = stream_offsets(table.withColumn("n_tokens", F.size("tokens")), "doc_id")
    drawn = sample_windows(offs, 60, 32, seed=5, world_size=2, batch_size=4).collect()
    key = lambda r: (r["rank"], r["sample_id"])
    assert [r["window"] for r in sorted(drawn, key=key)] == [r["window"] for r in sorted(got, key=key)]
    with pytest.raises(ValueError):
        windows_from_files(spark, path, 1, len(want) - 1)
    with pytest.raises(FileNotFoundError):
        windows_from_files(spark, scratch_path(spark, "t-nothing"), 1)


def test_random_access_reads_only_what_is_asked(spark, written):
    path, want = written
    files = TokenFiles(local(path))
    read = []
    opened = files.filesystem.open_input_file

    class Counting:
        def __init__(self, name):
            self.handle = opened(name)

        def seek(self, at):
            self.handle.seek(at)

        def read(self, n):
            read.append(n)
            return self.handle.read(n)

        def close(self):
            self.handle.close()

    files.filesystem = type("F", (), {"open_input_file": staticmethod(Counting)})
    for at in (0, 1000, len(want) - 33):
        assert files.read(at, 33).tolist() == want[at:at + 33]
    assert sum(read) == 3 * 33 * 2
    with pytest.raises(EOFError):
        files.read(len(want) - 5, 6)


def test_a_data_set_needs_all_its_splits(spark):
    root = scratch_path(spark, "t-splits")
    rows = spark.createDataFrame([(0, "train", [1, 2]), (0, "val", [3])],
                                 "start long, split string, tokens array<int>")
    write_token_stream(rows, root, route_col="split")
    got = {(r["split"], tuple(r["tokens"])) for r in read_token_splits(spark, root).collect()}
    assert got == {("train", (1, 2)), ("val", (3,))}
    shutil.rmtree(f"{local(root)}/val")
    with pytest.raises(FileNotFoundError, match="no data set"):
        read_token_splits(spark, root)


def test_a_crash_while_publishing_leaves_the_version_before(spark, monkeypatch):
    from quire.sources import tokenbin

    root = local(scratch_path(spark, "t-crash"))
    one = spark.createDataFrame([(0, [1, 2])], "start long, tokens array<int>")
    write_token_stream(one, root)
    before = stream_state(root)
    with open(f"{root}/_new-half.json", "w") as fh:     # written aside, never renamed
        fh.write('{"dtype": "uint16", "parts"')
    assert stream_state(root) == before and flat(spark, root) == [1, 2]
    assert [v for v, _ in tokenbin._manifest_versions(*tokenbin._fs(root))] == [0]


def sink_rows(spark, ids):
    return spark.createDataFrame([(i, f"text {i} " * (i % 3 + 1)) for i in ids],
                                 "doc_id long, text string")


def expected(spark, ids):
    path = scratch_path(spark, "t-expected")
    prepare_corpus(sink_rows(spark, ids), path)
    return {s: flat(spark, f"{path}/{s}") for s in ("train", "val")}


def streams(spark, path):
    return {s: flat(spark, f"{path}/{s}") for s in ("train", "val")}


IDS = list(range(0, 900, 3))


def test_epochs_are_written_once_also_when_replayed(spark):
    path = scratch_path(spark, "t-sink")
    sink = TokenFileSink(path)
    sink(sink_rows(spark, IDS[:150]), 0)
    sink(sink_rows(spark, IDS[:150]), 0)
    saved = local(scratch_path(spark, "t-saved"))
    shutil.copytree(f"{local(path)}/val", saved)
    sink(sink_rows(spark, IDS[150:]), 1)
    want = expected(spark, IDS)
    assert want["val"] and streams(spark, path) == want
    # as if the run had died after the train stream was published, before the val stream was
    shutil.rmtree(f"{local(path)}/val")
    shutil.copytree(saved, f"{local(path)}/val")
    TokenFileSink(path)(sink_rows(spark, IDS[150:]), 1)
    assert streams(spark, path) == want
    files = [f for f in os.listdir(f"{local(path)}/train") if f.endswith(".bin")]
    assert len(files) == len(stream_state(f"{path}/train")["parts"])
    TokenFileSink(path, writer="other")(sink_rows(spark, [5000, 5001]), 0)   # epochs of its own
    assert len(streams(spark, path)["train"]) > len(want["train"])


def test_a_stream_of_files_becomes_token_files(spark):
    root = scratch_path(spark, "t-st1k1")
    stage_in_order(sink_rows(spark, IDS), "doc_id", 4, f"{root}/in")
    schema = "doc_id long, text string"
    for _ in range(2):          # the second run finds nothing new
        src = file_stream(spark, f"{root}/in", schema, max_files_per_trigger=1)
        stream_token_files(src, f"{root}/out", f"{root}/_ck").awaitTermination()
    assert streams(spark, f"{root}/out") == expected(spark, IDS)


def test_live_counter_grows_to_the_final_count(spark):
    root = scratch_path(spark, "t-live")
    stage_in_order(sink_rows(spark, IDS), "doc_id", 4, f"{root}/in")
    src = file_stream(spark, f"{root}/in", "doc_id long, text string", max_files_per_trigger=1)
    seen = []
    counter = LiveCounter(stream_tokenize(src, f"{root}/out", f"{root}/_ck"))
    total = counter.follow(lambda rows, tokens: seen.append((rows, tokens)), every=0.05)
    out = spark.read.parquet(f"{root}/out")
    assert total == (len(IDS), out.agg(F.sum("n_tokens")).first()[0])
    assert seen == sorted(seen) and seen[-1] == total and len(counter.batches) == 4


@pytest.mark.parametrize("budget", [None, 2500, 5000])
def test_continued_runs_leave_the_streams_of_one_run(spark, budget):
    whole, parts = scratch_path(spark, "t-whole"), scratch_path(spark, "t-parts")
    prepare_corpus(sink_rows(spark, IDS), whole, max_tokens=budget)
    for upto in (100, 100, 200, 300):       # growing tables; the second run brings nothing
        continue_corpus(sink_rows(spark, IDS[:upto]), parts, max_tokens=budget)
    assert streams(spark, parts) == streams(spark, whole)
    assert stream_state(f"{parts}/train")["last_key"] == stream_state(f"{whole}/train")["last_key"]


def test_a_cut_off_continuation_is_completed(spark):
    path = scratch_path(spark, "t-cut")
    continue_corpus(sink_rows(spark, IDS[:150]), path)
    saved = local(scratch_path(spark, "t-saved"))
    shutil.copytree(f"{local(path)}/val", saved)
    continue_corpus(sink_rows(spark, IDS[:250]), path)
    shutil.rmtree(f"{local(path)}/val")
    shutil.copytree(saved, f"{local(path)}/val")
    continue_corpus(sink_rows(spark, IDS), path)
    assert streams(spark, path) == expected(spark, IDS)
