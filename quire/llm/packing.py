"""Best-fit packing by length-histogram planning.

Only the number of pieces of every length matters to a packing, so best-fit runs over
those counts on the driver (at most ``capacity`` numbers, whatever the corpus): all
pieces of a length that meet equal room are placed by one arithmetic run.  A piece then
takes its planned slot by its rank within its length, which is its rank within its task
plus the number of such pieces in the tasks before.  No piece is compared with another.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import bound_batches, materialize

CAPACITY = 2048
SEPARATOR = 0
#: Texts that go to a Python worker, and bytes of tokens that come back, at a time.
TEXTS_PER_BATCH, BATCH_BYTES = 1000, 1 << 20

_PIECES = ("doc_id long, piece int, start long, length int, ids_crc32 long, tokens binary, "
           "part int, turn long")


#: Fixed value: how byte-level vocabularies split a text before merging.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                      r"|\s+(?!\S)|\s+")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies are written in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranks(definition: dict) -> dict[bytes, int] | None:
    """Merge ranks of a plain byte-level BPE, where a merge's rank is its result's id."""
    model, split = definition["model"], definition.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel"
             and split.get("use_regex", True) and not split.get("add_prefix_space")
             and not definition.get("normalizer") and not definition.get("post_processor")
             and not any(model.get(x) for x in (
                 "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                 "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    bytes_of, vocab = _byte_of_char(), model["vocab"]
    added = {x["content"] for x in definition.get("added_tokens", [])}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    words = {w: i for w, i in vocab.items() if w not in added}
    if made != sorted(set(made)) or any(c not in bytes_of for w in words for c in w):
        return None
    ranks = {bytes(bytes_of[c] for c in w): i for w, i in words.items()}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


class _Codec:
    """Ids of a ``tokenizers`` definition.

    A plain byte-level BPE is encoded through its ranks, which gives the same ids in a
    third of the time; texts that hold an added token, and whatever the rank encoder
    refuses, go to ``tokenizers`` itself, as does every other kind of definition.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        content = json.loads(definition)
        self.added = [x["content"] for x in content.get("added_tokens", [])]
        ranks, self.fast = _ranks(content), None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of white space beyond its stack
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def _codec(definition: str) -> _Codec:
    return _Codec(definition)


def cut_points(length: int, capacity: int) -> list[int]:
    """Ends of the pieces of a document: all of ``capacity`` but for a shorter first one."""
    first = length if length <= capacity else length % capacity or capacity
    return list(range(first, length + 1, capacity))


def _pieces(definition: str, capacity: int):
    """(doc_id, text) -> the document's pieces, ranked within this task and their length."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(),
             pa.int64())
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        codec = _codec(definition)
        part = TaskContext.get().partitionId()
        turns: dict[int, int] = {}
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = codec.ids(text.as_py() or "")
                data = ids.astype("<u4").tobytes() + SEPARATOR.to_bytes(4, "little")
                start = 0
                for piece, end in enumerate(cut_points(len(ids) + 1, capacity)):
                    own = data[4 * start:4 * end]
                    turn = turns.get(end - start, 0)
                    turns[end - start] = turn + 1
                    out.append((doc_id, piece, start, end - start, zlib.crc32(own), own, part,
                                turn))
                    start = end
                held += len(data)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return run


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit, longest first, over the number of pieces of each length.

    Runs ``(length, first rank, first sequence, pieces per sequence, offset)``: the piece
    of rank ``first rank + j`` goes to sequence ``first sequence + j // per`` at ``offset
    + (j % per) * length``.  Sequences of equal room are filled together: after one piece
    the same sequence has the least room that fits, until no further piece does.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    spans: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    rooms: list[int] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room not in spans:
            spans[room] = []
            insort(rooms, room)
        spans[room].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = spans[room].pop()
                if not spans[room]:
                    del spans[room], rooms[k]
            else:
                room = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            per = room // length
            runs.append((length, rank, first, per, capacity - room))
            placed = min(left, n * per)
            full, over = divmod(placed, per)
            left, rank = left - placed, rank + placed
            if full:
                put(room - per * length, first, full)
            if over:
                put(room - over * length, first + full, 1)
            rest = n - full - (over > 0)
            if rest:
                put(room, first + n - rest, rest)
    return runs


def _slots(runs: list[tuple[int, int, int, int, int]]):
    """Column function (length, rank) -> struct<sequence_id, offset>."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size = length.to_numpy(zero_copy_only=False).astype(np.int64)
        rank = rank.to_numpy(zero_copy_only=False).astype(np.int64)
        run = table[np.searchsorted(keys, (size << 44) | rank, side="right") - 1]
        sequence, turn = np.divmod(rank - run[:, 1], run[:, 3])
        return pa.StructArray.from_arrays(
            [pa.array(run[:, 2] + sequence), pa.array((run[:, 4] + turn * size).astype(np.int32))],
            names=["sequence_id", "offset"])

    return F.arrow_udf(place, "sequence_id long, offset int")


def pack_documents(docs: DataFrame, definition: str, *, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, tokens, sequence_id, offset``, a row a piece.

    ``definition`` is a ``tokenizers`` JSON (its text, so that no executor needs the
    file).  A document is its ids and id 0; null and empty texts are that id alone.
    Only documents longer than ``capacity`` are cut.  ``tokens`` holds the piece's ids as
    little-endian unsigned 32-bit numbers, ``sequence_id`` numbers the sequences from 0
    and ``offset`` is the piece's place in its own.  Every row of ``docs`` is a document:
    repeated rows and null doc_ids are packed as often as they occur.  Other columns are
    ignored; an empty table gives no rows.
    """
    if not 0 < capacity < 1 << 18:
        raise ValueError("capacity must be 1 to 262143")
    bound_batches(docs.sparkSession, TEXTS_PER_BATCH)
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
        .mapInArrow(_pieces(definition, capacity), _PIECES), "pieces")
    held = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")),
                       "piece-counts")
    counts = {r["length"]: r["n"] for r in
              held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    upto = F.sum("n").over(W.partitionBy("length").orderBy("part"))
    before = held.select("length", "part", (upto - F.col("n")).alias("before"))
    slot = _slots(plan_slots(counts, capacity))("length", "rank")
    return (pieces.join(before, ["length", "part"])
            .withColumn("rank", F.col("before") + F.col("turn"))
            .withColumn("slot", slot)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "tokens",
                    "slot.sequence_id", "slot.offset"))


def packed_sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, n_pieces, tokens``: the pieces of ``pack_documents`` joined up.

    A sequence is one group of at most ``capacity`` pieces.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "tokens")))
    whole = F.expr("aggregate(ordered, X'', (a, x) -> concat(a, x.tokens))")
    return (placed.groupBy("sequence_id").agg(
                F.sum("length").cast("int").alias("n_tokens"),
                F.count("*").cast("int").alias("n_pieces"), ordered.alias("ordered"))
            .select("sequence_id", "n_tokens", "n_pieces", whole.alias("tokens")))
