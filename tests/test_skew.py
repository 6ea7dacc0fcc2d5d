"""A hot key holding a third of the rows: exact results, bounded group sizes."""

import random

from pyspark.sql import functions as F

from quire.operators.neighbors import row_index
from quire.operators.runlog import early_stop, mark_improvements
from quire.operators.scan import BUCKET, add_order_bucket


def test_hot_run_is_split_and_exact(spark):
    rnd = random.Random(0)
    rows = []
    for it in range(3000):                                   # hot run: 1/3 of all rows
        rows.append((0, it, rnd.random() * 10))
    for run in range(1, 201):
        for it in range(30):
            rows.append((run, it, rnd.random() * 10))
    df = spark.createDataFrame(rows, "run_id long, iter long, val_loss double")
    b = add_order_bucket(df, "iter", 16)
    sizes = [r["n"] for r in b.groupBy("run_id", BUCKET).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3000 / 4                            # the hot run spans many buckets

    idx = {(r["run_id"], r["iter"]): r["idx"] for r in
           row_index(df, ["run_id"], ["iter"], n_buckets=16).collect()}
    assert all(idx[(r, i)] == i for r, i, _v in rows)

    got = {r["run_id"]: r for r in early_stop(mark_improvements(df, n_buckets=16), 7).collect()}
    vals = [v for r, _i, v in rows if r == 0]
    best, pat, stop = 1e9, 0, None
    for i, v in enumerate(vals):
        if v < best:
            best, pat = v, 0
        else:
            pat += 1
            if pat >= 7:
                stop = i
                break
    assert got[0]["stop_iter"] == stop
