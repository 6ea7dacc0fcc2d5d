"""G1-G4 and A5 over logits arrays, as higher-order SQL functions (JVM-side).

All folds are left-to-right ``aggregate`` calls, so the result does not depend
on partitioning, and the draw uses a hash uniform keyed by ``(seed, row, step)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.hashing import md5_uniform


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, x: a + x)


def scale(logits, temperature: float = 1.0) -> Column:
    """G1: divide by the temperature."""
    z = _c(logits).cast("array<double>")
    return z if temperature == 1.0 else F.transform(z, lambda x: x / F.lit(float(temperature)))


def top_k_threshold(z, k: int) -> Column:
    """The k-th largest value (k capped at the size); ties at it are all kept."""
    z = _c(z)
    kk = F.least(F.lit(k), F.size(z))
    return F.get(F.sort_array(z, asc=False), kk - 1)


def softmax(z, keep=None) -> Column:
    """Numerically stable softmax; ``keep`` (lambda x -> bool) zeroes the rest."""
    z = _c(z)
    m = F.array_max(z)
    w = F.transform(z, lambda x: F.exp(x - m) if keep is None else
                    F.when(keep(x), F.exp(x - m)).otherwise(F.lit(0.0)))
    tot = _dsum(w)
    return F.transform(w, lambda x: x / tot)


def with_sampled_token(df, logits_col: str, key_col: str, out_col: str = "token",
                       seed: int = 1234, step=0, temperature: float = 1.0,
                       top_k: int | None = None):
    """Temperature, top-k (ties kept), softmax, inverse-CDF multinomial draw.

    The uniform is ``md5(seed:row:step)``, so any partitioning gives the same id.
    Intermediate arrays are staged as columns: Spark does not share common
    sub-expressions inside lambdas, so one nested expression would recompute the
    weights once per element.
    """
    tmp = ["_z", "_m", "_thr", "_w", "_tot", "_u"]
    out = df.withColumn("_z", scale(F.col(logits_col), temperature))
    out = out.withColumn("_m", F.array_max("_z"))
    if top_k is not None:
        out = out.withColumn("_thr", top_k_threshold("_z", top_k))
        out = out.withColumn("_w", F.transform(
            "_z", lambda x: F.when(x >= F.col("_thr"), F.exp(x - F.col("_m"))).otherwise(F.lit(0.0))))
    else:
        out = out.withColumn("_thr", F.lit(None).cast("double"))
        out = out.withColumn("_w", F.transform("_z", lambda x: F.exp(x - F.col("_m"))))
    out = out.withColumn("_tot", _dsum(F.col("_w")))
    step_col = step if isinstance(step, Column) else F.lit(step)
    out = out.withColumn("_u", md5_uniform(seed, F.col(key_col), step_col))
    target = F.col("_u") * F.col("_tot")
    init = F.struct(F.lit(0.0).alias("cum"), F.lit(-1).alias("pick"), F.lit(-1).alias("last"),
                    F.lit(0).alias("i"))
    res = F.aggregate(
        "_w", init,
        lambda acc, w: F.struct(
            (acc["cum"] + w).alias("cum"),
            F.when((acc["pick"] < 0) & (acc["cum"] + w > target), acc["i"])
            .otherwise(acc["pick"]).alias("pick"),
            F.when(w > 0, acc["i"]).otherwise(acc["last"]).alias("last"),
            (acc["i"] + 1).alias("i")))
    # u < 1, so a pick exists unless rounding leaves target == total: then the last kept id
    pick = F.when(res["pick"] >= 0, res["pick"]).otherwise(res["last"])
    return out.withColumn(out_col, pick).drop(*tmp)


def masked_nll(logits, target) -> Column:
    """A5: ``-log softmax(logits)[target]``; NULL when target = -1 (ignored)."""
    z = _c(logits).cast("array<double>")
    t = _c(target)
    m = F.array_max(z)
    lse = m + F.log(_dsum(F.transform(z, lambda x: F.exp(x - m))))
    return F.when(t == -1, F.lit(None).cast("double")).otherwise(lse - F.get(z, t))
