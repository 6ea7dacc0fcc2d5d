"""train/val routing by a seeded, partition-independent hash draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.hashing import md5_uniform

# Fixed values of the reference preparation scripts.
VAL_FRACTION = 0.01
SPLIT_SEED = 1337


def split_expr(key, fraction: float = VAL_FRACTION, seed: int = SPLIT_SEED) -> Column:
    """'val' when md5-uniform(seed, key) < fraction (strict), else 'train'."""
    return F.when(md5_uniform(seed, key) < F.lit(fraction), F.lit("val")).otherwise(F.lit("train"))


def assign_split(df: DataFrame, key: str = "doc_id", fraction: float = VAL_FRACTION,
                 seed: int = SPLIT_SEED, out_col: str = "split") -> DataFrame:
    """Add ``split``; identical for any partitioning, retry or engine."""
    return df.withColumn(out_col, split_expr(key, fraction, seed))
