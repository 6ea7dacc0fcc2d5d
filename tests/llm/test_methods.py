"""Methods against plain restatements: rank-order distance, rates, templates, incremental scans."""

import collections
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, mixing, secrets
from quire.llm.chat import Template, chat_digest, format_chats
from quire.session import scratch_path


def plain_grams(text):
    """n-grams of one to three letters: (letters) with '_' for a word's edge."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    found = collections.Counter()
    for w in words:
        found.update(w)
        found.update(f"_{w}_"[i:i + 3] for i in range(len(w)))
    if words:
        line = "_" + "_".join(words) + "_"
        found.update(line[i:i + 2] for i in range(len(line) - 1))
    return found


def code(gram):
    """The number that stands for an n-gram: 21 bits a letter, its length in the top bits."""
    a = [0 if c == "_" else ord(c) for c in gram]
    if len(a) == 1:
        return a[0]
    if len(a) == 2:
        return (a[0] << 21) | a[1] | (1 << 62)
    return ((a[0] << 42) | (a[1] << 21) | a[2]) | (1 << 61)


def ranked(counter):
    return [code(g) for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))][:langid.PROFILE]


def test_grams_ranks_distances_and_predictions(spark):
    rnd = random.Random(4)
    stems = {"aa": ["mer", "sol", "luz", "cielo"], "bb": ["haus", "und", "ßtraße", "wald"],
             "cc": ["the", "of", "and", "river"]}
    rows = []
    for lang, ws in stems.items():
        for _ in range(25):
            rows.append((len(rows), " ".join(rnd.choice(ws) + rnd.choice(["", "e", "s", "ing"])
                                             for _ in range(rnd.randint(3, 60))), lang))
    rows += [(900, "mer und the", None), (901, "THE Wald, the sol!", None), (902, "xyz q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = {}
    for i, t, lang in rows:
        if lang is not None:
            learned.setdefault(lang, collections.Counter()).update(plain_grams(t))
    want = {lang: ranked(c) for lang, c in learned.items()}
    assert langid.fit_profiles(df, sample=10**9) == want
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict_language(
        F.col("text"), want).alias("p")).collect()}
    for i, t, _ in rows:
        own = ranked(plain_grams(t))
        apart = {lang: sum(abs(p.index(g) - k) if g in p else langid.PROFILE
                           for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i].lang_pred == best
        assert abs(got[i].score - (1 - apart[best] / (langid.PROFILE * len(own)))) < 1e-12


def solved(tokens, q, targets, steps):
    """The same least squares by plain projected gradient on dense arrays."""
    rate, mass = np.ones(len(tokens)), tokens @ q
    for _ in range(steps):
        have = (rate * tokens) @ q
        use = mass > 0
        rate = np.maximum(0, rate - q[:, use] @ ((have[use] - targets[use]) / mass[use]))
    return (rate * tokens) @ q


@pytest.mark.parametrize("targets,soon", [
    ((400.0, 300.0, 300.0), True), ((900.0, 60.0, 40.0), False), ((0.0, 500.0, 500.0), False)])
def test_rates_equal_a_plain_solver_and_say_when_they_miss(spark, targets, soon):
    rng = np.random.default_rng(2)
    q = rng.dirichlet([0.4, 0.4, 0.4], 60)
    tokens = rng.integers(1, 40, 60).astype(float)
    rows = [(int(t), *map(float, p)) for t, p in zip(tokens, q)]
    members = spark.createDataFrame(rows, "tokens long, q_0 double, q_1 double, q_2 double")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = mixing.fit_rates(members, list(targets), steps=40).collect()
    have = np.array([sum(r.rate * r.tokens * r[f"q_{k}"] for r in got) for k in range(3)])
    assert all(r.rate >= 0 for r in got)
    missed = [w for w in said if issubclass(w.category, mixing.TargetsNotMet)]
    want = solved(tokens, q, np.array(targets), 40)
    assert np.allclose(have, want, rtol=1e-3, atol=0.5)
    assert bool(missed) == (np.abs(have - targets).max() > 1e-6 * sum(targets))
    if soon:        # the others need more steps, or cannot be met at all
        assert np.abs(have - targets).max() < 0.01 * sum(targets)
    else:
        assert missed


BRACKETS = dict(open="[", head="] ", close=" [end]\n")


@pytest.mark.parametrize("change", [
    BRACKETS,                                                   # no marker has an escaped character
    dict(head=":\n"), dict(close="\n"), dict(close=""), dict(escapes=(("<", "l"), (">", "g"))),
    dict(escapes=(("\\", "b"), ("<", "b"), (">", "g"))),
    dict(escapes=(("\\", "b"), ("<", "l"), ("<", "g"), (">", "h"))),
    dict(escapes=(("\\", "b"), ("<", ">"), (">", "g"))),
    dict(head="<", close="<a"), dict(open="</turn>\nx"), dict(head=">", close=">")])
def test_templates_that_cannot_be_read_back_are_refused(change):
    with pytest.raises(ValueError):
        Template(**change)


@pytest.mark.parametrize("template", [
    Template(), Template(open="@", head="|> ", close="{end}\n",
                         escapes=(("\\", "b"), ("|", "p"), ("{", "c"))),
    Template(open="", head="~", close="^", escapes=(("\\", "\n"), ("~", "1"), ("^", "2")),
             loss_roles=("user", "assistant"))])
def test_any_accepted_template_round_trips_hostile_texts(spark, template):
    pieces = [template.open, template.head, template.close, "\\", "\\l", "a", "\n",
              *[c for c, _ in template.escapes], *[x for _, x in template.escapes]]
    rnd = random.Random(1)
    rows = [(k // 4, k, rnd.choice(["user", "assistant", template.head, template.open + "x"]),
             "".join(rnd.choices(pieces, k=rnd.randrange(9)))) for k in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import hashlib

    got = {r.conv_id: r for r in chat_digest(format_chats(df, template), template).collect()}
    for conv in range(30):
        turns = [r for r in rows if r[0] == conv]
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(t for _, _, role, t in turns if role in template.loss_roles)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_an_incremental_scan_moves_only_unseen_texts(spark, monkeypatch):
    ledger = scratch_path(spark, "t-incremental")
    old = [(k, f"old text {k} password=abcdefgh{k}") for k in range(50)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    secrets.scan_secrets(make(old), ledger)
    moved = []
    scan = secrets._scan
    monkeypatch.setattr(secrets, "_scan", lambda blobs, rules: moved.append(blobs) or scan(blobs, rules))
    new = old + [(100, "new secret: zyxwvuts1"), (101, "new secret: zyxwvuts1"), (102, None)]
    paths, findings = secrets.scan_secrets(make(new), ledger)
    assert moved[0].count() == 2
    plan = moved[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")        # the filter lies below the grouping
    assert paths.count() == 53 and findings.count() == 51
    secrets.scan_secrets(make(new), ledger)
    assert len(moved) == 1                                          # nothing unseen, nothing scanned
