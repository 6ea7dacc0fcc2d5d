"""K5 K6 and M1 with a user model."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators.generate import bigram_model
from quire.operators.ngram import fit_ngram, score_windows, score_with_model
from quire.operators.report import observe_tokens
from quire.operators.runlog import read_run_log, write_run_log
from quire.session import scratch_path


def test_observe_tokens(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "doc_id long, n_tokens int")
    observed, obs = observe_tokens(df)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"n_rows": 2, "n_tokens": 7}


def test_run_log_append_and_read(spark):
    path = scratch_path(spark, "t-runlog")
    ev = spark.createDataFrame([(1, 0, 3.0, 3.1, 6e-4, 0.1), (1, 200, 2.0, 2.2, 5e-4, 0.2)],
                               "run_id long, iter long, train_loss double, val_loss double, "
                               "lr double, mfu double")
    write_run_log(ev, path, "eval")
    write_run_log(ev.withColumn("run_id", F.lit(2).cast("long")), path, "eval")
    back = read_run_log(spark, path, "eval")
    assert back.count() == 4 and back.select("run_id").distinct().count() == 2
    try:
        write_run_log(ev.drop("mfu"), path, "eval")
        raise AssertionError("missing column accepted")
    except ValueError:
        pass


def test_user_model_scoring_matches_join_scoring(spark):
    seqs = spark.createDataFrame([(1, [1, 2, 3, 2, 3, 4, 1, 2, 3])], "id long, tokens array<int>")
    counts = fit_ngram(seqs)
    logp = bigram_model(counts, 5).dense()

    def factory():
        table = logp

        def predict(x, y):
            return -table[x, y].mean(axis=1)
        return predict

    win = spark.createDataFrame([(0, [1, 2, 3], [2, 3, 2]), (1, [3, 4, 1], [4, 1, 2])],
                                "sample_id long, x array<int>, y array<int>")
    user = dict(score_with_model(win, factory, ["sample_id"], 3).collect())
    joined = score_windows(counts, win, 5, ["sample_id"]).groupBy("sample_id").agg(F.avg("nll"))
    for sid, v in joined.collect():
        assert np.isclose(user[sid], v)
