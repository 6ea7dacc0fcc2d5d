"""Random next-token windows with replacement, per rank, as a join.

The reference memory-maps one flat file and slices ``data[s:s+B+1]``.  Here the
stream stays a table of sequences with offsets: sequences are cut into pieces
at fixed chunk boundaries, every window is exploded over the (at most two)
chunks it touches, and the two sides meet in an equi-join on ``chunk``.  The
window side has ``n * world * 2`` rows - bounded by the parameters, not the
corpus - so it is broadcast when small and the corpus side is never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import window_x, window_y
from quire.functions.hashing import md5_bigint
from quire.operators.pack import _pieces
from quire.operators.tokenize import tokenize
from quire.session import bound_batches, ship_package
from quire.sources.tokenbin import TokenFiles, stream_state

MAX_BROADCAST_WINDOW_ROWS = 4_000_000


def window_starts(spark, n: int, block_size: int, n_tokens_col, seed: int = 1337,
                  world_size: int = 1, batch_size: int | None = None) -> DataFrame:
    """``(rank, sample_id, batch_id, start)``; start uniform on [0, N-B-1) per (seed+rank, id)."""
    ids = spark.range(0, n * world_size)
    rank = F.floor(F.col("id") / n).cast("int")
    sample_id = (F.col("id") % n).cast("bigint")
    span = n_tokens_col - block_size - 1
    w = ids.select(rank.alias("rank"), sample_id.alias("sample_id"))
    start = F.when(span > 0, F.pmod(md5_bigint(F.lit(seed) + F.col("rank"), F.col("sample_id")), span)) \
        .otherwise(F.raise_error(F.lit("stream too short: need more than block_size + 1 tokens")))
    w = w.withColumn("start", start.cast("bigint"))
    bs = batch_size or n
    return w.withColumn("batch_id", F.floor(F.col("sample_id") / bs).cast("bigint"))


def sample_windows(seqs: DataFrame, n: int, block_size: int = 512, seed: int = 1337,
                   world_size: int = 1, batch_size: int | None = None,
                   split_col: str = "split", start_col: str = "start",
                   tokens_col: str = "tokens", len_col: str = "n_tokens",
                   chunk: int | None = None, tokenizer=None, text_col: str = "text",
                   text_source: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``(rank, sample_id, batch_id, start, window, x, y)`` drawn from one split's stream.

    ``seqs`` holds the sequences of ONE split with their stream offsets.  The
    last token is never a target (start < N-B-1, as in the reference).  When
    ``seqs`` has no ``tokens`` column yet, only the sequences that overlap a
    drawn window are tokenized (from ``text_col`` with ``tokenizer``); with
    ``text_source`` (``id_col``, ``text_col``) ``seqs`` can be narrow offsets and
    the text of the touched sequences is fetched by a broadcast join.
    """
    spark = seqs.sparkSession
    width = block_size + 1
    c = chunk or width
    # stream length = sum of lengths (offsets are contiguous from 0): a narrow
    # aggregate, evaluated once as a scalar subquery
    total = seqs.select(F.sum(F.col(len_col)).cast("bigint")).scalar()
    wins = window_starts(spark, n, block_size, total, seed, world_size, batch_size)
    c_lo = F.floor(F.col("start") / c).cast("bigint")
    c_hi = F.floor((F.col("start") + width - 1) / c).cast("bigint")
    wins_x = wins.select("*", F.explode(F.sequence(c_lo, c_hi)).alias("chunk"))
    small = n * world_size * (width // c + 2) <= MAX_BROADCAST_WINDOW_ROWS

    # only sequences that overlap a drawn window are needed: find them on the
    # narrow (start, n_tokens) columns first, so the token column (often a
    # tokenizer UDF or a wide parquet column) is produced for those rows only
    s, ln = F.col(start_col), F.col(len_col)
    spans = seqs.select(start_col, F.explode(F.sequence(
        F.floor(s / c).cast("bigint"), F.floor((s + ln - 1) / c).cast("bigint"))).alias("chunk"))
    touched = spans.join(F.broadcast(wins_x.select("chunk").distinct()), "chunk", "left_semi") \
        .select(start_col).distinct()
    needed = seqs.join(touched, start_col, "left_semi")
    if text_source is not None:
        # narrow offsets: fetch the text of the touched sequences only.  They are
        # at most n * world * (B + 1) rows (every token of a window can start a
        # new sequence), so that side is broadcast and the text is never shuffled.
        bound = n * world_size * (width + 1)
        keys = needed.select(id_col, split_col, start_col, len_col)
        keys = F.broadcast(keys) if bound <= MAX_BROADCAST_WINDOW_ROWS else keys
        needed = text_source.select(id_col, text_col).join(keys, id_col)
    if tokens_col not in needed.columns:
        needed = tokenize(needed, text_col, tokenizer, out_col=tokens_col, len_col=None)
    pieces = _pieces(needed, block_size, c, c, split_col, start_col, [tokens_col], len_col) \
        .withColumnRenamed("block_id", "chunk")
    j = pieces.join(F.broadcast(wins_x) if small else wins_x, "chunk")
    p_start = F.col("piece_start")
    lo = F.greatest(F.col("start"), p_start)
    hi = F.least(F.col("start") + width, p_start + F.size(tokens_col))
    parts = j.where(hi > lo).select(
        "rank", "sample_id", "batch_id", "start", lo.alias("lo"),
        F.slice(tokens_col, (lo - p_start + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    out = parts.groupBy("rank", "sample_id", "batch_id", "start").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))),
                              lambda s: s["piece"])).alias("window"))
    return out.select("rank", "sample_id", "batch_id", "start", "window",
                      window_x("window").alias("x"), window_y("window").alias("y"))


# Windows that a task reads at a time.
WINDOWS_PER_BATCH = 1000


def _read_windows(path: str, width: int):
    """(rank, sample_id, batch_id, start) -> the same with the ``width`` ids at ``start``."""
    def run(batches):
        files = TokenFiles(path)
        for batch in batches:
            start = batch.column(3).to_numpy()
            out = np.empty((len(start), width), dtype=np.int32)
            for k in np.argsort(start, kind="stable"):      # forwards through the files
                out[k] = files.read(int(start[k]), width)
            ends = np.arange(0, (len(start) + 1) * width, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))],
                names=["rank", "sample_id", "batch_id", "start", "window"])
        files.close()
    return run


def windows_from_files(spark, path: str, n: int, block_size: int = 512, seed: int = 1337,
                       world_size: int = 1, batch_size: int | None = None) -> DataFrame:
    """W3/W4/W5 over S3: the windows of ``sample_windows``, read straight from a token stream.

    The manifest says how long the stream is and which part holds which offsets, so the
    windows are drawn without a look at the tokens, dealt over the tasks by offset, and
    each task reads the ``block_size + 1`` ids of its own windows and nothing else: the
    bytes read follow the number of windows, not the corpus.
    """
    state = stream_state(path)
    if state is None:
        raise FileNotFoundError(f"no data set in {path}")
    if state["n_tokens"] <= block_size + 1:
        raise ValueError("stream too short: need more than block_size + 1 tokens")
    ship_package(spark)
    bound_batches(spark, WINDOWS_PER_BATCH)
    wins = window_starts(spark, n, block_size, F.lit(state["n_tokens"]).cast("bigint"), seed,
                         world_size, batch_size)
    dealt = wins.select("rank", "sample_id", "batch_id", "start").repartitionByRange("start")
    out = dealt.mapInArrow(_read_windows(path, block_size + 1),
                           "rank int, sample_id long, batch_id long, start long, window array<int>")
    return out.select("*", window_x("window").alias("x"), window_y("window").alias("y"))
