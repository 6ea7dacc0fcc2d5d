"""Registered queries against their oracles, and the pipeline stage by stage."""

import sys

import pytest

sys.path.insert(0, "/root/repo/tests")

import corpus_pipeline  # noqa: E402
import oracle_harness  # noqa: E402
from quire.llm.langid import fit_profiles  # noqa: E402
from quire.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = oracle_harness.duck(SF)
    df = QUERIES[name](spark, SF)
    ours = oracle_harness.frame_digest(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(ORACLES[name])
    theirs = oracle_harness.frame_digest([x[0] for x in found.description], found.fetchall())
    assert ours[:3] == theirs[:3]


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_pipeline_stages(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.read.parquet(f"{SF}/documents.parquet")
    copy = base.where("n_chars > 400").first()
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 !?", "en", "s", 5),
           (9004, copy.text, None, "s", copy.n_chars), (9005, "the password=abcdefgh1 of the", None, "s", 1),
           (None, "the of and", "en", "s", 1)]
    docs = base.select(*columns.replace(" long", "").replace(" string", "").split(", ")).unionByName(
        spark.createDataFrame(odd, columns))
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        path = corpus_pipeline.scratch_path(spark, "t-" + name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
    after_language, after_copies = seen[1], seen[2]
    assert seen[0] - after_language == {9001, 9002, 9003}
    assert 9004 not in after_copies and copy.doc_id in after_copies | {copy.doc_id}
    assert docs.where("doc_id = 9005").first().text == "the [SECRET] of the"
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet")
             .where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & seen[-2] - seen[-1]) == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == seen[-1] and all(r.exact for r in last)
    assert fit_profiles(docs.limit(0)) == {}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


WORDS = {"clean": "river mountain forest meadow", "junk": "click buy cheap offer",
         "toxic": "awful hateful nasty vile"}


def _text(domain, i):
    return " ".join(f"{w} {domain}{(i * 7 + k) % 5}" for k, w in enumerate(WORDS[domain].split() * 5))


def _mixed(spark, docs, labels):
    """Texts by (doc_id, domain) after the mixing stage."""
    sf = corpus_pipeline.scratch_path(spark, "t-mix")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(
        f"{sf}/labels.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return [(r.doc_id, next(d for d, w in WORDS.items() if r.text.startswith(w.split()[0])))
            for r in corpus_pipeline.mixing(spark, frame, sf).collect()]


def _mixture(sizes, first=1000):
    docs, labels = [], []
    for domain, n in sizes.items():
        for _ in range(n):
            at = first + len(docs)
            docs.append((at, _text(domain, at)))
            labels.append((at, 1 if domain == "clean" else 0, 1 if domain == "toxic" else 0))
    return docs, labels


def test_mixing_stage_meets_its_shares(spark):
    # junk wants about 0.8 of its rows, toxic four times as many
    docs, labels = _mixture({"clean": 5000, "junk": 125, "toxic": 13})
    out = _mixed(spark, docs, labels)
    ids = [i for i, d in out if d == "clean"]
    assert len(ids) == len(set(ids)) == 5000
    for domain, share in corpus_pipeline.MIXTURE.items():
        got = sum(d == domain for _, d in out) / len(out)
        assert abs(got - share) < 0.003, (domain, got)


def test_mixing_stage_judges_rows_not_ids(spark):
    docs, labels = _mixture({"clean": 300, "junk": 300, "toxic": 10})
    twice = [(i, _text(d, i)) for i in range(200) for d in ("clean", "junk")]
    unnamed = [(None, _text("junk", i) + f" x{i}") for i in range(100)]
    out = _mixed(spark, docs + twice + unnamed, labels)
    assert sorted(i for i, d in out if d == "clean" and i is not None and i < 200) == list(range(200))
    assert sum(d == "junk" and i is not None and i < 200 for i, d in out) < 40
    assert sum(i is None for i, _ in out) < 40
