"""Quality rules as a short-circuit cascade.

Every rule rejects a document or passes it on, so the verdict does not depend on
their order but the work does.  A rule looks at measures of the text (its words, its
lines, ...), each taken at most once.  A hashed sample gives the seconds of every measure
on its own and the rejections of every rule; the rules are then ordered greedily by
rejections among what the ones before left over, per *marginal* second: a measure that an
earlier rule has taken, or that is wanted anyway, costs nothing again.  A document is not
looked at after its first rejection.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shingles import mix64, word_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
SAMPLE = 1000


@lru_cache(maxsize=1)
def _cases() -> np.ndarray:
    """Per code point: 1 for a lower-case letter (category Ll), 2 for an upper-case one (Lu), else 0."""
    kinds = {"Ll": 1, "Lu": 2}
    return np.fromiter((kinds.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)),
                       dtype=np.uint8, count=0x110000)


class Text:
    """One text; each measure is taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = word_hashes(self.data)
        n = len(w) - 2
        if n < 2:
            return 0
        h = mix64(mix64(mix64(w[:n]) + w[1:n + 1]) + w[2:])
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(n, dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(w), dtype=bool)
        for k in range(3):
            covered[k:k + n] |= again
        return int(covered.sum())

    @cached_property
    def marks(self) -> int:
        return self.text.count("!")

    @cached_property
    def cased(self) -> tuple[int, int]:
        """Upper-case letters and letters that have case."""
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        _, lower, upper = np.bincount(_cases()[codes], minlength=3).tolist()
        return upper, upper + lower


#: Measures in an order in which each comes after those it is made from.
MADE_FROM: dict[str, tuple[str, ...]] = {
    "data": (), "words": ("data",), "n_words": ("words",), "word_chars": (), "n_symbols": (),
    "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("data",), "cased": (), "marks": ()}


def taken_for(measures: Iterable[str]) -> frozenset[str]:
    """The measures and all that they are made from."""
    out: set[str] = set()
    for m in measures:
        out |= {m, *taken_for(MADE_FROM[m])}
    return frozenset(out)


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Text], bool]


# thresholds are shares of a document's own words, lines or letters
RULES = (
    Rule("few_words", ("n_words",), lambda t: t.n_words < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"),
         lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", ("n_symbols", "n_words"), lambda t: 100 * t.n_symbols > 20 * t.n_words),
    Rule("repeated_lines", ("n_dup_lines", "lines"),
         lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("word_length", ("n_words", "word_chars"),
         lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("capitals", ("cased",), lambda t: 100 * t.cased[0] > 60 * t.cased[1]),
    Rule("exclamations", ("marks", "n_words"), lambda t: 100 * t.marks > 30 * t.n_words),
)
NAMES = tuple(r.name for r in RULES)
#: What the base verdict rests on, and the counts that are returned for every document.
BASE = ("few_words", "repeated_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def named(names: Iterable[str]) -> list[Rule]:
    by_name = {r.name: r for r in RULES}
    return [by_name[n] for n in names]


@dataclass(frozen=True)
class Trial:
    """What the sample showed: mean seconds of each measure on its own and of each rule once
    its measures are there, and which rules reject which sampled text (rows: texts)."""

    rules: tuple[Rule, ...]
    measure_cost: dict[str, float]
    rule_cost: dict[str, float]
    rejected: np.ndarray

    def marginal(self, rule: Rule, have: frozenset[str]) -> float:
        """Seconds that the rule adds where the measures of ``have`` are already taken."""
        return (self.rule_cost[rule.name] + 1e-9
                + sum(self.measure_cost[m] for m in taken_for(rule.needs) - have))

    def order(self, first: Sequence[str] = (), have: Iterable[str] = ()) -> list[str]:
        """The other rules, best first, after the rules ``first`` and the measures ``have``.

        Rules that reject nothing more come last, cheapest first.
        """
        known = taken_for([*have, *[m for r in self.rules if r.name in first for m in r.needs]])
        left = np.ones(len(self.rejected), dtype=bool)
        rest = dict(enumerate(self.rules))
        for k in [k for k, r in rest.items() if r.name in first]:
            left &= ~self.rejected[:, k]
            del rest[k]
        out = []
        while rest:
            cost = {k: self.marginal(r, known) for k, r in rest.items()}
            k = max(rest, key=lambda k: (self.rejected[left, k].sum() / cost[k], -cost[k], -k))
            rule = rest.pop(k)
            out.append(rule.name)
            known |= taken_for(rule.needs)
            left &= ~self.rejected[:, k]
        return out

    def work(self, order: Sequence[str], have: Iterable[str] = ()) -> tuple[float, float]:
        """Rule evaluations and seconds a document, by this sample, if ``order`` is followed."""
        at = {r.name: k for k, r in enumerate(self.rules)}
        known, left = taken_for(have), np.ones(len(self.rejected), dtype=bool)
        tried = seconds = 0.0
        for name in order:
            rule = self.rules[at[name]]
            tried += left.sum()
            seconds += left.sum() * self.marginal(rule, known)
            known |= taken_for(rule.needs)
            left &= ~self.rejected[:, at[name]]
        n = max(1, len(left))
        return tried / n, seconds / n


def _try(names: tuple[str, ...]):
    rules = named(names)

    def run(batches):
        for m in MADE_FROM:                         # tables and caches are made before the clock runs
            getattr(Text("a b"), m)
        for batch in batches:
            spent, rejected = [], []
            for text in batch.column(0):
                t, took, out = Text(text.as_py()), [], []
                for m in MADE_FROM:
                    began = time.perf_counter()
                    getattr(t, m)
                    took.append(time.perf_counter() - began)
                for r in rules:
                    began = time.perf_counter()
                    out.append(bool(r.rejects(t)))
                    took.append(time.perf_counter() - began)
                spent.append(took)
                rejected.append(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spent, pa.list_(pa.float64())), pa.array(rejected, pa.list_(pa.bool_()))],
                names=["spent", "rejected"])
    return run


def try_rules(docs: DataFrame, names: Sequence[str] = NAMES, sample: int = SAMPLE) -> Trial | None:
    """Trial on about ``sample`` documents taken by hash, at most four times as many; None
    where there are none.  Only their seconds and verdicts reach the driver."""
    rows = docs.select("doc_id").count()
    if not rows:
        return None
    share = min(1.0, sample / rows)
    draw = F.pmod(F.xxhash64(F.lit("cascade"), F.col("doc_id").cast("string")),
                  F.lit(1 << 20)) / float(1 << 20)
    got = (docs.where(draw < share).select(F.col("text").cast("string").alias("text"))
           .mapInArrow(_try(tuple(names)), "spent array<double>, rejected array<boolean>")
           .limit(4 * sample).collect())
    if not got:
        return None
    cost = np.mean([r["spent"] for r in got], axis=0).tolist()
    return Trial(tuple(named(names)), dict(zip(MADE_FROM, cost)),
                 dict(zip(names, cost[len(MADE_FROM):])),
                 np.array([r["rejected"] for r in got], dtype=bool))


def plan_cascade(docs: DataFrame, *, names: Sequence[str] = NAMES, first: Sequence[str] = (),
                 have: Iterable[str] = (), sample: int = SAMPLE) -> list[str]:
    """Names of the rules other than ``first`` in the order to try them (see ``Trial.order``);
    without documents the given order."""
    trial = try_rules(docs, names, sample)
    if trial is None:
        return [n for n in names if n not in first]
    return trial.order(first, have)


def cascade(text: Column, order: Sequence[str]) -> Column:
    """Whether no rule of ``order`` rejects the text."""
    return tried(text, order).isNull()


def tried(text: Column, order: Sequence[str]) -> Column:
    """Place in ``order`` (from 1) of the rule that rejects the text, where the cascade stops
    looking at it; null if it passes all of them."""
    rules = named(order)

    def stop(texts: pd.Series) -> pd.Series:
        return pd.Series([next((k for k, r in enumerate(rules, 1) if r.rejects(t)), None)
                          for t in map(Text, texts)], dtype="Int32")

    return F.pandas_udf(stop, "int")(text)


def cascade_report(docs: DataFrame, order: Sequence[str]) -> DataFrame:
    """``place, rule, tried, rejected``: how many rows each rule was asked about and rejected.

    Counted before anything is shuffled; a rule that no row reached has zeros.
    """
    spark, n = docs.sparkSession, len(order)
    stops = (docs.select(tried(F.coalesce(F.col("text").cast("string"), F.lit("")), order)
                         .alias("stop")).groupBy("stop").agg(F.count("*").alias("rows")))
    rules = spark.createDataFrame([(k, r) for k, r in enumerate(order, 1)], "place int, rule string")
    reached = F.coalesce(F.col("stop"), F.lit(n + 1)) >= F.col("place")
    return (rules.join(F.broadcast(stops), reached, "left").groupBy("place", "rule").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("tried"),
        F.coalesce(F.sum(F.when(F.col("stop") == F.col("place"), F.col("rows"))), F.lit(0))
        .alias("rejected")))


def judge(text: Column, order: Sequence[str]) -> Column:
    """The base counts of a text, the base verdict and the cascade's.

    The counts and the base verdict are wanted for every text; the rules of ``order`` are
    tried on those that pass it, until one rejects.
    """
    base, rules = named(BASE), named(n for n in order if n not in BASE)

    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in map(Text, texts):
            failed = any(r.rejects(t) for r in base)
            rows.append((*[getattr(t, c) for c in COUNTS], failed,
                         not failed and not any(r.rejects(t) for r in rules)))
        return pd.DataFrame(rows, columns=[*COUNTS, "base_failed", "kept"])

    return F.pandas_udf(measure, ", ".join(f"{c} long" for c in COUNTS)
                        + ", base_failed boolean, kept boolean")(text)


def apply_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null and empty texts have no words and fail.  Ids are only carried along (null and
    repeated ones too), other columns ignored; an empty table gives no rows.
    """
    order = plan_cascade(docs, first=BASE, have=COUNTS)
    found = judge(F.coalesce(F.col("text").cast("string"), F.lit("")), order)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
            .select("doc_id", "found.*"))
