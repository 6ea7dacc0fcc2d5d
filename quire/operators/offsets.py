"""W1/A3 stream offsets and P7/P8 token budgets (two-phase prefix sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.scan import prefix_aggregate


def stream_offsets(df: DataFrame, order_by: list[str] | str = "doc_id", len_col: str = "n_tokens",
                   split_col: str | None = "split", out_col: str = "start",
                   n_buckets: int | None = None, split_cardinality: int = 2,
                   quantile_source: DataFrame | None = None,
                   n_parts: int | None = None) -> DataFrame:
    """Position of each sequence in its split's flat stream (exclusive prefix sum).

    Documents are concatenated end to end in ``order_by`` order; ``start`` is the
    global offset of the first token, so the stream never has to exist as one file.
    ``n_parts``: see ``prefix_aggregate``.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return prefix_aggregate(
        df, order, {out_col: ("sum", F.col(len_col).cast("bigint"))},
        partition_by=[split_col] if split_col else None, inclusive=False,
        n_buckets=n_buckets, partition_cardinality=split_cardinality,
        quantile_source=quantile_source, n_parts=n_parts)


def token_budget(df: DataFrame, max_tokens: int, order_by: list[str] | str = "doc_id",
                 len_col: str = "n_tokens", zero_is_unlimited: bool = False,
                 n_buckets: int | None = None,
                 quantile_source: DataFrame | None = None) -> DataFrame:
    """Keep sequences until the running total (all splits) reaches ``max_tokens``.

    A sequence is kept iff the tokens before it are fewer than ``max_tokens``, so
    the one that crosses the limit is kept, and with ``max_tokens = 0`` the first
    one still is (pre-train form).  ``zero_is_unlimited`` gives the SFT form.
    Adds ``budget_start`` (tokens before the row, over both splits).
    """
    if zero_is_unlimited and max_tokens == 0:
        return df
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    with_start = prefix_aggregate(
        df, order, {"budget_start": ("sum", F.col(len_col).cast("bigint"))},
        partition_by=None, inclusive=False, n_buckets=n_buckets,
        quantile_source=quantile_source)
    return with_start.where((F.col("budget_start") < F.lit(max_tokens))
                            | (F.col("budget_start") == 0))
