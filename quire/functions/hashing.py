"""Hash-derived uniforms.

Every random draw in the library is a pure function of ``(seed, key...)`` built
from ``md5``, so it is the same for any partitioning, on any retry, and in
DuckDB (``md5`` and hex parsing exist there too).  Worker RNGs are never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    parts += [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.concat_ws(":", *parts)


def md5_uniform(seed, *cols) -> Column:
    """Uniform in [0, 1) from the first 32 bits of ``md5('seed:k1:k2...')``."""
    h = F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 8), 16, 10).cast("bigint")
    return h / F.lit(TWO_32)


def md5_bigint(seed, *cols) -> Column:
    """Non-negative 60-bit integer from ``md5('seed:k1:...')`` (first 15 hex digits).

    Used for uniform integers over ranges far wider than 2^32 (window starts in
    a multi-billion-token stream); ``pmod`` by the range has negligible bias.
    """
    return F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 15), 16, 10).cast("bigint")
