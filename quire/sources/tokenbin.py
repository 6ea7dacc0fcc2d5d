"""``tokenbin`` - flat headerless token files as a Spark data source.

Format: a directory of part files ``part-<offset>-<attempt>.bin``, each a headerless
little-endian array (``<u2`` tokens or ``<i4`` labels) that starts at that offset of
the stream.  ``_manifest-<version>.json`` lists the parts in order with their token
counts and the dtype; the listed parts concatenated are exactly the flat file.  The
manifest of the highest version counts.  It is written under another name and then
renamed, so a crash at any moment leaves the stream as the version before says.
``token_meta.json`` is the token metadata sidecar (vocab size, end-of-text id, dtype,
token count).  A single raw file, or a directory of raw files taken in name order,
can be read too.

Write: rows carry their stream offset; each task writes one part per run of
contiguous offsets, under its final name (names include the attempt).  The driver's
``commit`` orders the parts by offset, checks that they tile the stream from its
beginning, and publishes them by writing the next manifest; what that does not
list (parts of an overwritten stream, of failed attempts) is deleted after that.
Nothing is moved, and speculative or retried tasks never leave duplicate data.
``append`` continues the stream of an existing manifest: its rows' offsets go on
where that ends.  ``epoch`` (``writer:number``) makes an append happen once: a stream
whose manifest already holds that epoch of that writer is left as it is, so a replayed
micro-batch adds nothing, also where only one of two streams had been published.
``last_key`` is kept in the manifest for runs that go on from there.  The path must be
shared storage on a cluster (any ``pyarrow.fs`` URI).

Read: one input partition per byte range of ``chunk_tokens`` tokens, rows of
``row_tokens`` tokens: ``(file, part, offset, tokens)`` where ``offset`` is the
global position in the stream.  Comparisons of ``offset`` with a number are pushed into
the reader (``spark.sql.python.filterPushdown.enabled``): ranges outside are never
opened.  The dtype is the manifest's; an option that says otherwise is an error, and
without a manifest the default is uint16.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
                                    LessThanOrEqual, WriterCommitMessage)

from quire.session import bound_batches

# On-disk dtypes (little-endian) and their id ranges.
DTYPES = {"uint16": ("<u2", 0, 65535), "int32": ("<i4", -(2 ** 31), 2 ** 31 - 1)}
READ_SCHEMA = "file string, part int, offset bigint, tokens array<int>"
# Tokens per hash span of the writer (64 Mi tokens = 128 MiB as uint16).
SEGMENT_TOKENS = 1 << 26
# Tokens that a task converts at a time, and rows that go to a writer at a time.
SLICE_TOKENS, ROWS_PER_BATCH = 1 << 20, 1000
MANIFEST = re.compile(r"_manifest-(\d+)\.json")


def _fs(path: str):
    from urllib.parse import urlparse

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _manifest_versions(filesystem, root: str) -> list[tuple[int, str]]:
    """``(version, file)`` of the published manifests, oldest first."""
    from pyarrow import fs as pafs

    found = filesystem.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    return sorted((int(m[1]), i.path) for i in found if (m := MANIFEST.fullmatch(i.base_name)))


def _manifest(filesystem, root: str) -> dict | None:
    versions = _manifest_versions(filesystem, root.rstrip("/"))
    if not versions:
        return None
    with filesystem.open_input_stream(versions[-1][1]) as fh:
        return json.loads(fh.read().decode())


def _publish(filesystem, folder: str, manifest: dict) -> None:
    """Make ``manifest`` the current one of ``folder``: written aside, then renamed."""
    versions = _manifest_versions(filesystem, folder)
    version = versions[-1][0] + 1 if versions else 0
    aside = f"{folder}/_new-{uuid.uuid4().hex}.json"
    with filesystem.open_output_stream(aside) as fh:
        fh.write(json.dumps(manifest).encode())
    filesystem.move(aside, f"{folder}/_manifest-{version:08d}.json")
    for _, old in versions:
        filesystem.delete_file(old)


def stream_state(path: str) -> dict | None:
    """The manifest of a stream (``n_tokens``, ``parts``, ``epochs``, ``last_key``), if it has one."""
    filesystem, root = _fs(path)
    return _manifest(filesystem, root)


def _list_parts(path: str):
    """(file, n_bytes) in stream order, and the dtype recorded in the manifest."""
    from pyarrow import fs as pafs

    filesystem, root = _fs(path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.File:
        return filesystem, [(root, info.size)], None
    m = _manifest(filesystem, root)
    if m is not None:
        return filesystem, [(f"{root.rstrip('/')}/{p['file']}", p["bytes"]) for p in m["parts"]], \
            m.get("dtype")
    sel = pafs.FileSelector(root, recursive=False)
    files = sorted((i.path, i.size) for i in filesystem.get_file_info(sel)
                   if i.type == pafs.FileType.File and i.base_name.endswith(".bin"))
    if not files:
        raise FileNotFoundError(f"no token files in {path}")
    return filesystem, files, None


class TokenFiles:
    """Random access to a token stream: only the bytes asked for are read.

    One part is open at a time, so reads in rising order open every part once.
    """

    def __init__(self, path: str):
        self.filesystem, files, dtype = _list_parts(path)
        self.dtype = np.dtype(DTYPES[dtype or "uint16"][0])
        self.files = [f for f, _ in files]
        self.starts = np.cumsum([0] + [n // self.dtype.itemsize for _, n in files])
        self.at, self.handle = -1, None

    def read(self, offset: int, count: int) -> np.ndarray:
        """The ids at ``offset .. offset + count``; raises if the stream ends before."""
        out, have = np.empty(count, dtype=np.int32), 0
        while have < count:
            part = int(np.searchsorted(self.starts, offset + have, side="right")) - 1
            if not 0 <= part < len(self.files):
                raise EOFError(f"the stream ends before {offset + count}")
            if part != self.at:
                self.close()
                self.handle, self.at = self.filesystem.open_input_file(self.files[part]), part
            take = min(count - have, int(self.starts[part + 1]) - offset - have)
            self.handle.seek((offset + have - int(self.starts[part])) * self.dtype.itemsize)
            raw = self.handle.read(take * self.dtype.itemsize)
            out[have:have + take] = np.frombuffer(raw, dtype=self.dtype)
            have += take
        return out

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.at, self.handle = -1, None


@dataclass
class _Range(InputPartition):
    file: str
    part: int
    first: int       # first token inside the file
    count: int       # tokens in this range
    base: int        # global offset of the file's first token
    dtype: str = "uint16"


class TokenBinReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.dtype = options.get("dtype")
        self.chunk = int(options.get("chunk_tokens", str(1 << 24)))
        self.row_tokens = int(options.get("row_tokens", str(1 << 16)))
        self.least, self.most = 0, None      # offsets of the first and last row wanted

    def pushFilters(self, filters):
        """Keep the bounds on ``offset``; every filter is also left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("offset",) and isinstance(
                    getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    top = f.value - isinstance(f, LessThan)
                    self.most = top if self.most is None else min(self.most, top)
            yield f

    def partitions(self):
        _fs_, files, man_dtype = _list_parts(self.path)
        if man_dtype and self.dtype and man_dtype != self.dtype:
            raise ValueError(f"{self.path} holds {man_dtype}, not {self.dtype}")
        dtype = man_dtype or self.dtype or "uint16"
        width = np.dtype(DTYPES[dtype][0]).itemsize
        out, base = [], 0
        for part, (f, nbytes) in enumerate(files):
            if nbytes % width:
                raise ValueError(f"{f}: size {nbytes} is not a multiple of {width}")
            n = nbytes // width
            for chunk in range(0, n, self.chunk):
                # whole rows only, from the first that is wanted to the last
                end = min(chunk + self.chunk, n)
                skip = max(0, -(-(self.least - base - chunk) // self.row_tokens))
                first = chunk + skip * self.row_tokens
                if self.most is not None:
                    rows = (self.most - base - chunk) // self.row_tokens + 1
                    end = min(end, chunk + max(0, rows) * self.row_tokens)
                if first < end:
                    out.append(_Range(f, part, first, end - first, base, dtype))
            base += n
        return out or [_Range("", -1, 0, 0, 0)]

    def read(self, partition: _Range):
        if partition.count == 0:
            return
        dt = DTYPES[partition.dtype][0]
        width = np.dtype(dt).itemsize
        filesystem, _ = _fs(self.path)
        rows = max(1, SLICE_TOKENS // self.row_tokens)
        with filesystem.open_input_file(partition.file) as fh:
            fh.seek(partition.first * width)
            for at in range(0, partition.count, rows * self.row_tokens):
                count = min(rows * self.row_tokens, partition.count - at)
                vals = np.frombuffer(fh.read(count * width), dtype=dt).astype(np.int32)
                starts = np.arange(0, len(vals), self.row_tokens, dtype=np.int64)
                offs = np.append(starts, len(vals)).astype(np.int32)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([partition.file] * n, pa.string()),
                    pa.array(np.full(n, partition.part, dtype=np.int32)),
                    pa.array(partition.base + partition.first + at + starts),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(vals)),
                ], names=["file", "part", "offset", "tokens"])


@dataclass
class _Written(WriterCommitMessage):
    files: list          # [(folder, first_offset, file, n_tokens, n_bytes)]


class TokenBinWriter(DataSourceArrowWriter):
    """K1/K2 sink.

    Rows carry their stream offset (option ``offset_col``, default ``start``) and
    arrive sorted by ``(route, offset)`` inside each task; any partitioning is
    fine.  With option ``route_col`` (e.g. ``split``) every value gets its own stream
    under ``path/<value>/`` - one job writes train and val.  Several aligned columns
    (``column="tokens,labels"``, ``dtype="uint16,int32"``) are written by the same job,
    each below ``path/<column>/``.
    """

    def __init__(self, options, schema, overwrite):
        self.path = options["path"].rstrip("/")
        self.columns = options.get("column", "tokens").split(",")
        self.dtypes = options.get("dtype", "uint16").split(",")
        if len(self.dtypes) != len(self.columns):
            raise ValueError("one dtype per column is needed")
        self.offset_col = options.get("offset_col", "start")
        self.route_col = options.get("route_col")
        self.routes = [r for r in options.get("routes", "").split(",") if r]
        self.vocab_size = options.get("vocab_size")
        self.eot_id = options.get("eot_id")
        self.epoch = options.get("epoch", "").rsplit(":", 1) if options.get("epoch") else None
        self.last_key = json.loads(options["last_key"]) if "last_key" in options else None
        self.overwrite = overwrite

    def _folder(self, root: str, column: str, route) -> str:
        several = [column] if len(self.columns) > 1 else []
        return "/".join([root, *several, *([] if route is None else [str(route)])])

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        tag = f"{ctx.partitionId() if ctx else 0}-{ctx.attemptNumber() if ctx else 0}-" \
              f"{uuid.uuid4().hex[:8]}"
        filesystem, root = _fs(self.path)
        kinds = [DTYPES[d] for d in self.dtypes]
        done: list = []
        open_streams: list = []        # [(folder, file, stream, width)] of the current run
        route, first, expected = None, 0, -1

        def close():
            for folder, name, stream, width in open_streams:
                stream.close()
                n = expected - first
                done.append((folder, first, name, n, n * width))
            open_streams.clear()

        try:
            for batch in iterator:
                at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
                starts = batch.column(at[self.offset_col]).to_numpy(zero_copy_only=False)
                cols = [batch.column(at[c]) for c in self.columns]
                offs = [c.offsets.to_numpy() - c.offsets[0].as_py() for c in cols]
                sizes = np.diff(offs[0])
                values = []
                for c, o, (dt, lo, hi), dtype in zip(cols, offs, kinds, self.dtypes):
                    if (np.diff(o) != sizes).any():
                        raise ValueError("aligned columns differ in length")
                    v = c.flatten().to_numpy(zero_copy_only=False)
                    if len(v) and (v.min() < lo or v.max() > hi):
                        raise ValueError(
                            f"token id outside [{lo}, {hi}] cannot be stored as {dtype}")
                    values.append(v)
                rows = np.flatnonzero(sizes)
                if not len(rows):
                    continue
                routes = (np.array(batch.column(at[self.route_col]).to_pylist(), dtype=object)[rows]
                          if self.route_col else np.full(len(rows), None, dtype=object))
                begin, size, rel = starts[rows], sizes[rows], offs[0][:-1][rows]
                broken = np.ones(len(rows), dtype=bool)
                broken[1:] = (begin[1:] != begin[:-1] + size[:-1]) | (routes[1:] != routes[:-1])
                edges = np.append(np.flatnonzero(broken), len(rows))
                for a, b in zip(edges[:-1], edges[1:]):   # one write per contiguous run
                    if not open_streams or routes[a] != route or begin[a] != expected:
                        close()
                        route, first = routes[a], int(begin[a])
                        for column, (dt, _, _) in zip(self.columns, kinds):
                            folder = self._folder(root, column, route)
                            filesystem.create_dir(folder, recursive=True)
                            name = f"{folder}/part-{first:020d}-{tag}.bin"
                            open_streams.append((folder, name, filesystem.open_output_stream(name),
                                                 np.dtype(dt).itemsize))
                    end = int(rel[b - 1] + size[b - 1])
                    for (_, _, stream, _), v, (dt, _, _) in zip(open_streams, values, kinds):
                        for at in range(int(rel[a]), end, SLICE_TOKENS):
                            stream.write(v[at:min(at + SLICE_TOKENS, end)].astype(dt).tobytes())
                    expected = int(begin[b - 1] + size[b - 1])
            close()
        finally:
            for _, _, stream, _ in open_streams:
                stream.close()
        return _Written(done)

    def commit(self, messages):
        from pyarrow import fs as pafs

        filesystem, root = _fs(self.path)
        routes: list = list(self.routes) if self.route_col else [None]
        found: dict = {}
        for m in messages:
            for folder, *part in (m.files if m is not None else []):
                found.setdefault(folder, []).append(part)
        streams = {}
        for column, dtype in zip(self.columns, self.dtypes):
            for r in routes:              # expected streams exist even when empty
                streams[self._folder(root, column, r)] = (column, dtype)
        prefix = {c: self._folder(root, c, None) + "/" for c in self.columns}
        for folder in found:
            column = next(c for c in self.columns if (folder + "/").startswith(prefix[c]))
            streams.setdefault(folder, (column, self.dtypes[self.columns.index(column)]))
        plans = []
        for folder, (column, dtype) in streams.items():
            old = None if self.overwrite else _manifest(filesystem, folder)
            if old is not None and old["dtype"] != dtype:
                raise ValueError(f"{folder} holds {old['dtype']}, cannot append {dtype}")
            parts = list(old["parts"]) if old else []
            expect = old["n_tokens"] if old else 0
            epochs = dict(old.get("epochs", {})) if old else {}
            if self.epoch is not None:
                writer, number = self.epoch[0], int(self.epoch[1])
                if epochs.get(writer, -1) >= number:   # published before: this is a replay
                    for _first, f, _n, _nb in found.get(folder, []):
                        filesystem.delete_file(f)
                    continue
                epochs[writer] = number
            for first, f, n, nb in sorted(found.get(folder, [])):
                if first != expect:
                    raise ValueError(f"{folder}: part at {first}, expected {expect}")
                expect = first + n
                parts.append({"file": f.rsplit("/", 1)[1], "offset": first, "tokens": n,
                              "bytes": nb})
            last = self.last_key if self.last_key is not None else (old or {}).get("last_key")
            plans.append((folder, parts, {"dtype": dtype, "column": column, "n_tokens": expect,
                                          "parts": parts, "epochs": epochs, "last_key": last}))
        for folder, parts, manifest in plans:
            filesystem.create_dir(folder, recursive=True)
            meta = {"dtype": manifest["dtype"], "n_tokens": manifest["n_tokens"],
                    "vocab_size": int(self.vocab_size) if self.vocab_size else None,
                    "eot_id": int(self.eot_id) if self.eot_id else None}
            with filesystem.open_output_stream(f"{folder}/token_meta.json") as fh:
                fh.write(json.dumps(meta).encode())
            _publish(filesystem, folder, manifest)
            listed = {p["file"] for p in parts}
            for i in filesystem.get_file_info(pafs.FileSelector(folder, recursive=False)):
                if i.base_name.endswith(".bin") and i.base_name not in listed:
                    filesystem.delete_file(i.path)

    def abort(self, messages):
        filesystem, _root = _fs(self.path)
        for m in messages or []:
            for _folder, _first, f, _n, _nb in (m.files if m is not None else []):
                try:
                    filesystem.delete_file(f)
                except (FileNotFoundError, OSError):
                    pass


class TokenBinDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tokenbin"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return TokenBinReader(self.options, schema)

    def writer(self, schema, overwrite):
        return TokenBinWriter(self.options, schema, overwrite)


_REGISTERED: set[tuple] = set()


def register(spark: SparkSession) -> None:
    from quire.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    key = (spark.sparkContext.applicationId, id(spark))
    if key not in _REGISTERED:
        spark.dataSource.register(TokenBinDataSource)
        _REGISTERED.add(key)


def write_token_stream(seqs: DataFrame, path: str, column: str = "tokens", dtype: str = "uint16",
                       order_col: str = "start", route_col: str | None = None,
                       n_parts: int | None = None, vocab_size: int | None = None,
                       eot_id: int | None = None,
                       routes: tuple[str, ...] | None = ("train", "val"),
                       repartition: bool = True, mode: str = "overwrite",
                       epoch: str | None = None, last_key=None) -> None:
    """K1/K3: write sequences as token streams in ``order_col`` order.

    ``column`` and ``dtype`` may name several aligned columns, separated by commas.

    With ``route_col`` (``split``) one job writes every stream, each under
    ``path/<value>``, and every value in ``routes`` gets a stream even when it
    has no rows (like the reference's always-created val file); otherwise
    ``seqs`` must hold one stream.  ``repartition=False`` keeps the input
    partitioning - right when it already groups contiguous offsets, as the
    output of ``stream_offsets`` does (whole order buckets per task), and then
    the write needs no shuffle at all.  ``epoch`` and ``last_key``: see the module.
    """
    spark = seqs.sparkSession
    register(spark)
    bound_batches(spark, ROWS_PER_BATCH)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    route = [route_col] if route_col else []
    cols = seqs.select(*route, order_col, *column.split(","))
    if repartition:
        # hash on (route, offset span): every span lands whole in one task, spans
        # are token-balanced by construction, and no sampling pass is needed
        span = F.floor(F.col(order_col) / F.lit(SEGMENT_TOKENS))
        cols = cols.repartition(n, *route, span)
    # a local sort makes each task's rows one contiguous run per span / bucket
    ordered = cols.sortWithinPartitions(*route, order_col)
    w = ordered.write.format("tokenbin").mode(mode).option("dtype", dtype) \
        .option("column", column).option("offset_col", order_col)
    if route_col:
        w = w.option("route_col", route_col)
        if routes:
            w = w.option("routes", ",".join(routes))
    if vocab_size is not None:
        w = w.option("vocab_size", str(vocab_size))
    if eot_id is not None:
        w = w.option("eot_id", str(eot_id))
    if epoch is not None:
        w = w.option("epoch", epoch)
    if last_key is not None:
        w = w.option("last_key", json.dumps(last_key))
    w.save(path)


def write_sft_bins(seqs: DataFrame, path: str, order_col: str = "start",
                   route_col: str | None = "split", n_parts: int | None = None,
                   repartition: bool = True) -> None:
    """K2: aligned ``tokens`` (uint16) and ``labels`` (int32) streams, per split, in one job."""
    write_token_stream(seqs, path, "tokens,labels", "uint16,int32", order_col, route_col, n_parts,
                       repartition=repartition)


def read_token_stream(spark: SparkSession, path: str, dtype: str | None = None,
                      chunk_tokens: int | None = None, row_tokens: int | None = None) -> DataFrame:
    """S3: ``(file, part, offset, tokens)``; a missing path raises (no dataset)."""
    register(spark)
    r = spark.read.format("tokenbin")
    if dtype:
        r = r.option("dtype", dtype)
    if chunk_tokens:
        r = r.option("chunk_tokens", str(chunk_tokens))
    if row_tokens:
        r = r.option("row_tokens", str(row_tokens))
    return r.load(path)


def read_token_range(spark: SparkSession, path: str, first: int, end: int,
                     row_tokens: int = 1 << 16) -> DataFrame:
    """S3: ``(offset, tokens)`` of the ids at ``first .. end`` of a stream.

    The bounds are pushed into the reader: only byte ranges that hold these offsets are read.
    """
    rows = read_token_stream(spark, path, row_tokens=row_tokens).where(
        (F.col("offset") > first - row_tokens) & (F.col("offset") < end))
    lo = F.greatest(F.col("offset"), F.lit(first))
    hi = F.least(F.col("offset") + F.size("tokens"), F.lit(end))
    return rows.where(hi > lo).select(
        lo.alias("offset"),
        F.slice("tokens", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
        .alias("tokens"))


def read_token_splits(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val"),
                      **options) -> DataFrame:
    """S3: ``(split, file, part, offset, tokens)`` of a prepared folder.

    A data set has all its splits: if any of them is missing there is none, and this
    raises ``FileNotFoundError`` before anything is read.
    """
    for split in splits:
        if stream_state(f"{root.rstrip('/')}/{split}") is None:
            raise FileNotFoundError(f"no data set in {root}: {split} is missing")
    out = None
    for split in splits:
        rows = read_token_stream(spark, f"{root.rstrip('/')}/{split}", **options).select(
            F.lit(split).alias("split"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_token_meta(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar as a one-row table; absent ``vocab_size`` -> 50304."""
    from quire.functions.schedule import DEFAULT_VOCAB

    meta = spark.read.option("multiLine", "true").schema(
        "dtype string, n_tokens bigint, vocab_size int, eot_id int").json(
        f"{path.rstrip('/')}/token_meta.json")
    return meta.withColumn("vocab_size", F.coalesce("vocab_size", F.lit(DEFAULT_VOCAB)))
