"""Best-fit packing against a best fit of single pieces and an exact read-back."""

import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.packing import cut_points, pack_documents, packed_sequences, plan_slots
from quire.llm.queries import TOKENIZER_FILE


def plain_best_fit(lengths, capacity):
    """Every piece by itself, longest first, into the sequence of least room that fits."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300), st.integers(40, 64))
def test_planned_slots_are_a_best_fit(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = plan_slots(counts, capacity)
    used = {}
    for n, count in counts.items():
        own = sorted(r for r in runs if r[0] == n)
        assert own[0][1] == 0
        for rank in range(count):
            run = [r for r in own if r[1] <= rank][-1]
            turn = rank - run[1]
            used.setdefault(run[2] + turn // run[3], []).append((run[4] + turn % run[3] * n, n))
    for slots in used.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_cut_points():
    assert cut_points(5, 5) == [5]
    assert cut_points(6, 5) == [1, 6]
    assert cut_points(15, 5) == [5, 10, 15]
    assert cut_points(1, 5) == [1]


@pytest.fixture(scope="module")
def definition():
    with open(TOKENIZER_FILE, encoding="utf-8") as f:
        return f.read()


def test_every_document_reads_back_from_its_slots(spark, definition):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choices(["alpha", "Ünïcode", "\n", "12", "x"], k=rnd.randrange(90))))
            for k in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (7, "again"), (7, "again"),
             (202, "long word " * 700), (203, "hot"), *[(300 + k, "hot") for k in range(60)]]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, b"") for i, t in rows],
                                 "doc_id long, text string, length int, part string, rank int, "
                                 "tokens binary").repartition(5)
    placed = pack_documents(docs, definition, capacity=64).cache()
    tok = Tokenizer.from_str(definition)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        start = 0
        for p, end in enumerate(cut_points(len(ids), 64)):
            data = np.array(ids[start:end], "<u4").tobytes()
            want.append((i, p, start, end - start, zlib.crc32(data), data))
            start = end
    found = placed.collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.tokens))
                   for r in found), key=key) == sorted(want, key=key)
    whole = {r.sequence_id: r for r in packed_sequences(placed).collect()}
    assert len(whole) == plain_best_fit([x[3] for x in want], 64)
    for r in found:
        row = whole[r.sequence_id]
        assert row.n_tokens * 4 == len(row.tokens) <= 256
        assert bytes(row.tokens[4 * r.offset:4 * (r.offset + r.length)]) == bytes(r.tokens)
    assert sum(r.n_tokens for r in whole.values()) == sum(x[3] for x in want)
    assert pack_documents(docs.limit(0), definition).collect() == []
    with pytest.raises(ValueError):
        pack_documents(docs, definition, capacity=0)


def test_rank_encoding_equals_the_definition_on_every_character(definition):
    from quire.llm.packing import _Codec

    codec = _Codec(definition)
    assert codec.fast is not None
    for lo in range(0, 0x110000, 512):
        text = "".join(f"a{c}b 1{c}2 .{c}, {c}{c} \n {c}\t" for c in map(chr, range(lo, lo + 512))
                       if not "\ud800" <= c <= "\udfff")
        assert codec.ids(text).tolist() == codec.whole.encode(text, add_special_tokens=False).ids


def test_added_tokens_white_space_runs_and_other_definitions(definition):
    import json

    from quire.llm.packing import _Codec

    codec = _Codec(definition)
    assert codec.ids("a<|endoftext|>b").tolist() == codec.whole.encode("a<|endoftext|>b").ids
    wide = " " * 1_200_000 + "x"
    assert codec.ids(wide).tolist() == codec.whole.encode(wide).ids
    other = json.loads(definition)
    other["normalizer"] = {"type": "Lowercase"}
    lower = _Codec(json.dumps(other))
    assert lower.fast is None
    assert lower.ids("ABC").tolist() == codec.ids("abc").tolist()
