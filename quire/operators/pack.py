"""Sequential fixed blocks over a split's token stream, without a flat stream.

Each sequence row ``(split, start, tokens[, labels])`` is exploded over the
block ids it overlaps and only the overlapping slice travels; pieces are
grouped by ``(split, block_id)`` and re-assembled in stream order.  Rows in the
shuffle scale with sequences + blocks, never with tokens, and every group
holds at most ``block_size + 1`` tokens, so one giant document becomes many
small groups instead of one hot one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that go to a block cutter at a time, and tokens that it holds before it gives blocks out.
ROWS_PER_BATCH, CUT_TOKENS = 1000, 1 << 20


def _pieces(df: DataFrame, block_size: int, width: int, stride: int, split_col: str,
            start_col: str, cols: list[str], len_col: str | None) -> DataFrame:
    """Explode sequences into (split, block_id, piece_start, slice(col)...) rows."""
    s = F.col(start_col)
    # use the stored length when there is one: filtering on size(udf(...)) would
    # make the optimizer evaluate a tokenizer UDF twice
    n = F.col(len_col) if len_col and len_col in df.columns else F.size(cols[0])
    # block k covers [k*stride, k*stride + width); it overlaps [s, s+n) when
    # k*stride < s+n and k*stride + width > s.
    k_lo = F.greatest(F.lit(0).cast("bigint"),
                      F.floor((s - width) / stride).cast("bigint") + 1)
    k_hi = F.floor((s + n - 1) / stride).cast("bigint")
    exploded = (df.where(n > 0)
                .select(F.col(split_col), s.alias("_s"), n.alias("_n"), *[F.col(c) for c in cols],
                        F.explode(F.sequence(k_lo, F.greatest(k_lo, k_hi))).alias("block_id"))
                .where(F.col("block_id") <= k_hi))
    lo = F.greatest(F.col("block_id") * stride, F.col("_s"))
    hi = F.least(F.col("block_id") * stride + width, F.col("_s") + F.col("_n"))
    return exploded.select(
        F.col(split_col), "block_id", lo.alias("piece_start"),
        *[F.slice(F.col(c), (lo - F.col("_s") + 1).cast("int"), (hi - lo).cast("int")).alias(c)
          for c in cols])


def _field(name: str):
    return lambda p: p[name]


def pack_blocks(df: DataFrame, block_size: int = 512, stride: int | None = None,
                tokens_col: str = "tokens", labels_col: str | None = None,
                split_col: str = "split", start_col: str = "start",
                keep_partial: bool = False, len_col: str | None = "n_tokens",
                method: str = "shuffle") -> DataFrame:
    """Blocks of ``block_size + 1`` tokens (x = first B, y = last B) every ``stride``.

    Input: one row per sequence with its stream offset ``start`` (see
    ``stream_offsets``).  Output: ``(split, block_id, start, tokens)``; the short
    tail is dropped unless ``keep_partial``.

    W7: with ``labels_col`` the block carries the aligned label slice of width
    ``block_size`` (labels are already shifted, so ``y = labels[s:s+B]``).

    ``method="shuffle"`` (default) explodes every sequence into per-block pieces
    and groups them: one pass over the tokens, one shuffle of them.
    ``"local"`` cuts blocks inside each task, writes them once and shuffles only the
    pieces that straddle a contiguous range (``pack_blocks_local``): what crosses the
    network is two pieces of a block per range, not the tokens.
    """
    if method == "local":
        return pack_blocks_local(df, block_size, stride, tokens_col, labels_col, split_col,
                                 start_col, keep_partial)
    stride = stride or block_size
    # next-token blocks need one extra token for the last target; label blocks
    # already hold their targets, so x and y are both B wide.
    width = block_size if labels_col else block_size + 1
    cols = [tokens_col] + ([labels_col] if labels_col else [])
    pieces = _pieces(df, block_size, width, stride, split_col, start_col, cols, len_col)
    assembled = pieces.groupBy(split_col, "block_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_start", *cols))).alias("_p"))
    out = assembled.select(
        split_col, "block_id", (F.col("block_id") * stride).alias("start"),
        *[F.flatten(F.transform("_p", _field(c))).alias(c) for c in cols])
    if not keep_partial:
        out = out.where(F.size(tokens_col) == width)
    return out


class _RunPacker:
    """Streaming block cutter for one task: rows arrive sorted by (split, start).

    A *run* is a maximal sequence of rows of one split with contiguous offsets.
    Blocks lying fully inside a run are emitted complete; blocks that cross a
    run's edge are emitted as pieces (joined later by a small group-by).
    Memory: the current run's not-yet-emitted tail plus its first ``width``
    tokens, whatever the run length.
    """

    def __init__(self, width: int, stride: int, n_cols: int):
        self.width, self.stride, self.n_cols = width, stride, n_cols
        self.split = None
        self.out, self.held = [], 0   # (split, block_id, piece_start, complete, [arrays]); tokens
        self._reset(None, 0)

    def _reset(self, split, start):
        self.split, self.run_start, self.buf_start = split, start, start
        self.buf = [np.zeros(0, np.int32) for _ in range(self.n_cols)]
        self.head = [np.zeros(0, np.int32) for _ in range(self.n_cols)]
        self.next_k = -(-start // self.stride)           # first block starting in the run

    @property
    def run_end(self):
        return self.buf_start + len(self.buf[0])

    def extend(self, split, start, arrays):
        if self.split is None or split != self.split or start != self.run_end:
            self.flush()
            self._reset(split, start)
        self.buf = [np.concatenate([b, a]) for b, a in zip(self.buf, arrays)]
        if len(self.head[0]) < self.width:
            need = self.width - len(self.head[0])
            self.head = [np.concatenate([h, a[:need]]) for h, a in zip(self.head, arrays)]
        self._emit_complete()

    def _emit_complete(self):
        w, s = self.width, self.stride
        last_k = (self.run_end - w) // s                  # last block ending inside the run
        if last_k >= self.next_k:
            ks = np.arange(self.next_k, last_k + 1, dtype=np.int64)
            idx = (ks * s - self.buf_start)[:, None] + np.arange(w)[None, :]
            self.out.append((self.split, ks, ks * s, True, [b[idx] for b in self.buf]))
            self.held += idx.size
            self.next_k = int(last_k + 1)
        keep_from = self.next_k * s - self.buf_start
        if keep_from > 0:
            self.buf = [b[keep_from:] for b in self.buf]
            self.buf_start += keep_from

    def flush(self):
        if self.split is None or self.run_end == self.run_start:
            return
        w, s, r0, r1 = self.width, self.stride, self.run_start, self.run_end
        # blocks that start before the run and reach into it: head pieces
        k = max(0, (r0 - w) // s + 1)
        while k * s < r0:
            hi = min(k * s + w, r1)
            if hi > r0:
                self.out.append((self.split, np.array([k]), np.array([r0]), False,
                                 [h[None, : hi - r0] for h in self.head]))
            k += 1
        # blocks that start inside the run but end after it: tail pieces
        k = self.next_k
        while k * s < r1:
            lo = k * s
            self.out.append((self.split, np.array([k]), np.array([lo]), False,
                             [b[None, lo - self.buf_start:] for b in self.buf]))
            k += 1
        self.split = None

    def drain(self):
        out, self.out, self.held = self.out, [], 0
        return out


def pack_blocks_local(df: DataFrame, block_size: int = 512, stride: int | None = None,
                      tokens_col: str = "tokens", labels_col: str | None = None,
                      split_col: str = "split", start_col: str = "start",
                      keep_partial: bool = False) -> DataFrame:
    """W6/W7 without shuffling the tokens: blocks are cut inside each task.

    Same result as ``pack_blocks`` for any input partitioning.  When the input is
    partitioned by contiguous stream ranges - the output of ``stream_offsets``
    holds whole order buckets per task - nearly every block is assembled where
    its tokens already are.  The input is computed once: a task writes its whole blocks
    and its edge pieces to shared storage in columns of their own, so that the second
    read, which groups the edges, never touches the blocks.
    """
    from quire.session import bound_batches, materialize, ship_package, trim_memory

    stride = stride or block_size
    width = block_size if labels_col else block_size + 1
    cols = [tokens_col] + ([labels_col] if labels_col else [])
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession, ROWS_PER_BATCH)
    src = df.select(split_col, start_col, *cols).sortWithinPartitions(split_col, start_col)
    arr = T.ArrayType(T.IntegerType(), False)
    edges = [f"_edge_{c}" for c in cols]
    schema = T.StructType([T.StructField(split_col, T.StringType()),
                           T.StructField("block_id", T.LongType(), False),
                           T.StructField("piece_start", T.LongType(), False)] +
                          [T.StructField(c, arr) for c in cols + edges])
    ints = pa.list_(pa.field("element", pa.int32(), False))
    pa_schema = pa.schema([pa.field(split_col, pa.string()), pa.field("block_id", pa.int64(), False),
                           pa.field("piece_start", pa.int64(), False)] +
                          [pa.field(c, ints) for c in cols + edges])

    def to_batch(items):
        # every item holds 2-D arrays (rows x piece length): no per-block Python work
        splits, ids, starts, comp = [], [], [], []
        vals = [[] for _ in cols]
        lens = [[] for _ in cols]
        for sp, ks, st, complete, arrays in items:
            n = len(ks)
            splits.append(np.full(n, sp, dtype=object))
            ids.append(np.asarray(ks, np.int64))
            starts.append(np.asarray(st, np.int64))
            comp.append(np.full(n, complete))
            for j, a in enumerate(arrays):
                vals[j].append(a.ravel())
                lens[j].append(np.full(n, a.shape[1], dtype=np.int64))
        whole = np.concatenate(comp)
        cols_out = [pa.array(np.concatenate(splits), pa.string()), pa.array(np.concatenate(ids)),
                    pa.array(np.concatenate(starts))]
        lists = []
        for j in range(len(cols)):
            offs = np.concatenate([[0], np.cumsum(np.concatenate(lens[j]))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(
                pa.array(offs), pa.array(np.concatenate(vals[j]).astype(np.int32))))
        for keep in (whole, ~whole):
            at = pa.array(np.arange(len(whole)), mask=~keep)
            cols_out += [x.take(at).cast(ints) for x in lists]
        return pa.RecordBatch.from_arrays(cols_out, schema=pa_schema)

    def run(batches):
        packer = _RunPacker(width, stride, len(cols))
        for b in batches:
            sp = b.column(0).to_pylist()
            st = b.column(1).to_numpy(zero_copy_only=False)
            lists = [b.column(2 + j) for j in range(len(cols))]
            offs = [lst.offsets.to_numpy() for lst in lists]
            vals = [lst.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
                    for lst in lists]
            for r in range(b.num_rows):
                lo, hi, at = offs[0][r], offs[0][r + 1], int(st[r])
                for x in range(lo, hi, CUT_TOKENS):     # a long sequence by stretches
                    y = min(x + CUT_TOKENS, hi)
                    packer.extend(sp[r], at + int(x - lo), [
                        v[o[r] - o[0] + x - lo: o[r] - o[0] + y - lo] for v, o in zip(vals, offs)])
                    if packer.held >= CUT_TOKENS:
                        yield to_batch(packer.drain())
            items = packer.drain()
            if items:
                yield to_batch(items)
        packer.flush()
        items = packer.drain()
        if items:
            yield to_batch(items)
        trim_memory()

    cut = materialize(src.mapInArrow(run, schema), "blocks")
    complete = cut.where(F.col(cols[0]).isNotNull()).select(split_col, "block_id", *cols)
    partial = cut.where(F.col(edges[0]).isNotNull()).groupBy(split_col, "block_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "piece_start", *[F.col(e).alias(c) for c, e in zip(cols, edges)]))).alias("_p"))
    joined = partial.select(split_col, "block_id",
                            *[F.flatten(F.transform("_p", _field(c))).alias(c) for c in cols])
    out = complete.unionByName(joined).select(
        split_col, "block_id", (F.col("block_id") * stride).alias("start"), *cols)
    if not keep_partial:
        out = out.where(F.size(tokens_col) == width)
    return out
