"""Rows and their neighbours in slots, against a plain pass over each conversation."""

import random

from pyspark.sql import functions as F

from quire.operators.neighbors import row_index, with_neighbours
from quire.sources.corpus import conversations_to_instructions

TURNS = "conv_id long, turn long, role string, text string"


def turns(seed):
    rnd = random.Random(seed)
    rows = []
    for conv, n in ((0, 600), (1, 1), *((c, rnd.randrange(1, 12)) for c in range(2, 120))):
        at = 0
        for _ in range(n):
            at += rnd.randrange(1, 4)
            rows.append((conv, at, rnd.choice(["user", "assistant", "system", None, "tool"]),
                         rnd.choice([None, "", f"text {conv} {at}"])))
    rnd.shuffle(rows)
    return rows


def by_conversation(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(r[0], []).append(r)
    return found


def test_pairs_of_a_hot_conversation_null_texts_and_roles(spark):
    rows = turns(1)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    want = []
    for conv in by_conversation(rows).values():
        for k, (a, b) in enumerate(zip(conv, conv[1:])):
            if a[2] == "user" and b[2] == "assistant":
                want.append((a[0], a[1], a[3], "", b[3], conv[k + 2][3] if k + 2 < len(conv) else None))
    got = conversations_to_instructions(df, with_following_text=True, n_buckets=6).collect()
    key = lambda r: r[:2]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    short = conversations_to_instructions(df, n_buckets=6).collect()
    assert sorted(map(tuple, short), key=key) == sorted((w[:5] for w in want), key=key)
    assert conversations_to_instructions(df.limit(0)).collect() == []


def test_neighbours_on_both_sides_and_rows_without_a_group(spark):
    rows = turns(2)
    df = spark.createDataFrame(rows + [(None, 1, "user", "lost"), (None, 2, "assistant", "too")], TURNS)
    role = F.col("role")
    got = with_neighbours(row_index(df, ["conv_id"], ["turn"], n_buckets=4), ["conv_id"], role == "user",
                          {"before": (-1, role == "system"), "far": (3, F.lit(True)),
                           "answer": (1, role == "assistant")}, ["text", "turn"]).collect()
    want = {(None, 1): (None, None, None)}
    for conv in by_conversation(rows).values():
        for k, r in enumerate(conv):
            if r[2] == "user":
                at = lambda i: conv[i] if 0 <= i < len(conv) else (0, 0, "", 0)
                want[r[:2]] = (at(k - 1)[1] if at(k - 1)[2] == "system" else None,
                               at(k + 3)[1] or None,
                               at(k + 1)[1] if at(k + 1)[2] == "assistant" else None)
    assert len(got) == len(want)
    assert {(r.conv_id, r.turn): tuple(x and x.turn for x in (r.before, r.far, r.answer))
            for r in got} == want


def test_texts_meet_in_one_exchange(spark):
    df = spark.createDataFrame(turns(3), TURNS)
    idx = row_index(df, ["conv_id"], ["turn"], n_buckets=4)
    pairs = with_neighbours(idx, ["conv_id"], F.col("role") == "user",
                            {"answer": (1, F.col("role") == "assistant")}, ["text"])
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(pairs) == exchanges(idx) + 1
