"""R5/R7 formulas as column expressions: learning-rate schedule, MFU, parameter count."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The MFU denominator (A100 bf16 peak FLOP/s) and the default
# vocabulary used when the token metadata has none.
PEAK_FLOPS = 312e12
DEFAULT_VOCAB = 50304


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def lr_at(it, warmup_iters, lr_decay_iters, learning_rate, min_lr, decay_lr=True) -> Column:
    """Linear warm-up, cosine decay to ``min_lr``, then constant ``min_lr``.

    ``decay_lr = False`` gives the constant ``learning_rate`` (warm-up skipped too).
    """
    it, w, d, lr, mn = (_c(x) for x in (it, warmup_iters, lr_decay_iters, learning_rate, min_lr))
    it_d = it.cast("double")
    warm = lr * (it_d + 1) / F.greatest(F.lit(1), w + 1).cast("double")
    ratio = (it_d - w) / F.greatest(F.lit(1), d - w).cast("double")
    ratio = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    coeff = 0.5 * (1.0 + F.cos(F.lit(math.pi) * ratio))
    sched = (F.when(it < w, warm).when(it > d, mn.cast("double"))
             .otherwise(mn + coeff * (lr - mn)))
    return F.when(_c(decay_lr), sched).otherwise(lr.cast("double"))


def gpt_param_count(vocab_size, block_size, n_layer, n_embd, bias=False,
                    non_embedding: bool = True) -> Column:
    """Parameters of the reference transformer (tied head), optionally minus positions."""
    v, t, l, c = (_c(x).cast("bigint") for x in (vocab_size, block_size, n_layer, n_embd))
    b = F.when(_c(bias), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    per_layer = 12 * c * c + 2 * c + b * (2 * c + 3 * c + c + 4 * c + c)
    total = v * c + t * c + l * per_layer + c + b * c
    return total - t * c if non_embedding else total


def mfu(n_params, n_layer, n_head, n_embd, block_size, fwdbwd_per_iter, dt_seconds) -> Column:
    """``(6N + 12 L H Q T) * T * fwdbwd / dt / 312e12`` with ``Q = n_embd // n_head``.

    Steps that share a timestamp (``dt = 0``) have no utilisation (NULL).
    """
    n, l, h, c, t, f = (_c(x).cast("double") for x in
                        (n_params, n_layer, n_head, n_embd, block_size, fwdbwd_per_iter))
    q = F.floor(c / h).cast("double")
    per_token = 6 * n + 12 * l * h * q * t
    return F.try_divide(per_token * t * f, _c(dt_seconds).cast("double")) / F.lit(PEAK_FLOPS)
