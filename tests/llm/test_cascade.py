"""The cascade's plan: marginal costs, the work an order saves, letters of odd case."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def trial(rejected, measure=None, rule=1e-6, names=q.NAMES):
    cost = {m: 1.0 for m in q.MADE_FROM} | (measure or {})
    return q.Trial(tuple(q.named(names)), cost, {n: rule for n in names},
                   np.array(rejected, dtype=bool).reshape(-1, len(names)))


def plain_work(t, order, have=()):
    """Text by text: the same count without arrays."""
    n = seconds = 0
    for row in t.rejected:
        taken = set(q.taken_for(have))
        for name in order:
            k = [r.name for r in t.rules].index(name)
            n += 1
            seconds += t.rule_cost[name] + 1e-9
            for m in q.taken_for(t.rules[k].needs) - taken:
                seconds += t.measure_cost[m]
                taken.add(m)
            if row[k]:
                break
    return n / len(t.rejected), seconds / len(t.rejected)


def test_a_measure_already_taken_costs_nothing_again():
    names = ("few_words", "symbols", "capitals")
    # symbols rejects less than capitals, but costs nothing once the counts are there
    t = trial([[0, 1, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0]], names=names)
    assert t.order() [0] == "capitals"
    assert t.order(have=q.COUNTS)[-1] == "capitals"
    assert t.order(first=("few_words",)) == ["capitals", "symbols"]
    assert t.marginal(q.named(["symbols"])[0], q.taken_for(q.COUNTS)) < 1e-5


def test_what_the_rules_before_rejected_counts_no_more():
    names = ("symbols", "capitals", "exclamations")
    t = trial([[1, 1, 0]] * 8 + [[0, 0, 1]] * 3 + [[0, 1, 0]], names=names,
              measure={"cased": 0.1, "data": 0, "words": 0, "n_words": 0})
    assert t.order() == ["capitals", "exclamations", "symbols"]


def test_work_equals_a_plain_count_and_the_plan_is_no_worse_than_most_orders():
    rng = np.random.default_rng(3)
    for _ in range(8):
        names = tuple(rng.permutation(q.NAMES)[:4].tolist())
        t = trial(rng.random((60, 4)) < rng.random(4) * 0.6, names=names,
                  measure={m: float(rng.random()) for m in q.MADE_FROM}, rule=0.01)
        work = {o: t.work(o) for o in itertools.permutations(names)}
        for o, w in work.items():
            assert np.allclose(w, plain_work(t, o))
        seconds = sorted(w[1] for w in work.values())
        assert t.work(t.order())[1] <= 1.35 * seconds[0]
        assert t.work(t.order())[1] <= seconds[len(seconds) // 3]


def test_a_planned_order_asks_less_and_verdicts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    junk = spark.range(4000).select((F.col("id") + 10**7).alias("doc_id"),
                                    F.lit("WHY!! " * 200).alias("text"))
    df = docs.unionByName(junk).repartition(4)
    planned = q.plan_cascade(df)
    backwards = planned[::-1]
    asked = {}
    for name, order in (("planned", planned), ("backwards", backwards)):
        report = {r.rule: r for r in q.cascade_report(df, order).collect()}
        rows = df.count()
        for rule in order:                     # each rule sees what those before it let through
            assert report[rule].tried == rows
            rows -= report[rule].rejected
        asked[name] = sum(r.tried for r in report.values())
        assert rows == df.where(q.cascade(F.col("text"), order)).count()
    assert asked["planned"] < asked["backwards"]
    empty = q.cascade_report(df.limit(0), planned).collect()
    assert len(empty) == len(planned) and all(r.tried == r.rejected == 0 for r in empty)


def test_case_is_that_of_letters(spark):
    odd = "ª º Ⓐ ⓐ ʰ ǅ ß É é".split()
    upper, cased = q.Text(" ".join(odd)).cased
    assert (upper, cased) == (1, 3)            # É; ß and é: the others are no upper or lower-case letters
    df = spark.createDataFrame([(1, "Ⓐ " * 60 + "é")], "doc_id long, text string")
    assert df.select(F.regexp_count("text", F.lit(r"\p{Lu}"))).first()[0] == 0
