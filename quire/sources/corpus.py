"""Corpus, instruction and conversation scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.neighbors import row_index, with_neighbours

INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("ex_id", T.LongType(), False),
    T.StructField("instruction", T.StringType(), True),
    T.StructField("input", T.StringType(), True),
    T.StructField("output", T.StringType(), True),
])


def read_corpus(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id",
                fmt: str = "parquet") -> DataFrame:
    """``(doc_id, text)``; the scan reads only these two columns.

    Whole-number ids become BIGINT; ids of any other type (strings) stay as they are.
    """
    rows = spark.read.format(fmt).load(path)
    whole = isinstance(rows.schema[id_col].dataType, T.IntegralType)
    key = F.col(id_col).cast("bigint") if whole else F.col(id_col)
    return rows.select(key.alias("doc_id"), F.col(text_col).alias("text"))


def normalize_instructions(df: DataFrame, id_col: str = "ex_id") -> DataFrame:
    """Absent instruction/input/output columns become '' (nulls stay for P2)."""
    cols = set(df.columns)
    return df.select(
        F.col(id_col).cast("bigint").alias("ex_id"),
        *[(F.col(c) if c in cols else F.lit("")).cast("string").alias(c)
          for c in ("instruction", "input", "output")])


def read_instructions(spark: SparkSession, path: str, fmt: str = "parquet",
                      id_col: str = "ex_id") -> DataFrame:
    return normalize_instructions(spark.read.format(fmt).load(path), id_col)


def conversations_to_instructions(conv: DataFrame, with_following_text: bool = False,
                                  n_buckets: int | None = None) -> DataFrame:
    """A ``user`` turn directly followed by an ``assistant`` turn -> one example.

    Output ``(conv_id, turn, instruction, input='', output)``; system turns and
    unanswered user turns are dropped.  With ``with_following_text`` the text of
    the turn after the answer is added as ``following`` (NULL at the end).
    """
    base = conv.select("conv_id", "turn", "role", "text")
    idx = row_index(base, ["conv_id"], ["turn"], n_buckets=n_buckets)
    role = F.col("role")
    near = {"answer": (1, role == "assistant")}
    if with_following_text:
        near["after"] = (2, F.lit(True))
    pairs = with_neighbours(idx, ["conv_id"], role == "user", near, ["text"]).where(
        "answer IS NOT NULL")
    cols = [F.col("conv_id"), F.col("turn"), F.col("text").alias("instruction"),
            F.lit("").alias("input"), F.col("answer.text").alias("output")]
    if with_following_text:
        cols.append(F.col("after.text").alias("following"))
    return pairs.select(*cols)
