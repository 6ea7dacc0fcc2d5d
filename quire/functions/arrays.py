"""Array expressions over token columns (all higher-order SQL functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT16_MAX = 65535


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mask_labels(tokens, prompt_len) -> Column:
    """Response-only next-token labels.

    ``labels[i] = tokens[i+1]`` when ``i+1 >= prompt_len`` and ``i`` is not the
    last position, else -1.  So the last prompt position predicts the first
    response token, end-of-text is a target, and nothing crosses examples.
    """
    t = _c(tokens)
    p = _c(prompt_len)
    return F.transform(
        t,
        lambda x, i: F.when((i < F.size(t) - 1) & (i + 1 >= p),
                            F.get(t, i + 1)).otherwise(F.lit(-1)),
    )


def crop_context(tokens, block_size: int) -> Column:
    """Keep the last ``block_size`` ids (empty arrays stay empty)."""
    t = _c(tokens)
    n = F.least(F.size(t), F.lit(block_size))
    return F.when(n == 0, t).otherwise(F.slice(t, -n, n))


def window_x(window) -> Column:
    """inputs = first B of a B+1 window."""
    w = _c(window)
    return F.slice(w, 1, F.size(w) - 1)


def window_y(window) -> Column:
    """targets = last B of a B+1 window (shifted by one)."""
    w = _c(window)
    return F.slice(w, 2, F.size(w) - 1)


def check_token_range(tokens, lo: int = 0, hi: int = UINT16_MAX) -> Column:
    """K3: raise when any id is outside [lo, hi]; otherwise the array itself."""
    t = _c(tokens)
    ok = F.forall(t, lambda x: (x >= lo) & (x <= hi))
    return F.when(ok | t.isNull(), t).otherwise(
        F.raise_error(F.lit(f"token id outside [{lo}, {hi}]: cannot narrow")))


def positional_checksum(tokens, base=None) -> Column:
    """sum(tokens[i] * (base + i + 1)) as BIGINT; an order-sensitive fingerprint."""
    t = _c(tokens)
    b = F.lit(0).cast("bigint") if base is None else _c(base).cast("bigint")
    return F.aggregate(
        F.transform(t, lambda x, i: x.cast("bigint") * (b + i + 1)),
        F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def array_sum(values) -> Column:
    return F.aggregate(_c(values), F.lit(0).cast("bigint"), lambda acc, v: acc + v.cast("bigint"))


def count_where(values, pred) -> Column:
    return F.size(F.filter(_c(values), pred))
