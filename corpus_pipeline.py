"""Corpus pipeline: from raw documents to sampled token sequences, stage by stage.

Each stage is one operator applied to all that the stage before kept; the rows are
written as Parquet and reread between stages, so a lost executor never costs more
than its stage.  Where a stage drops rows by id, the documents go through one exchange
at every size (merge joins), so that its cost follows the input.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.langid import UNKNOWN, fit_profiles, fold, predict_language
from quire.llm.minhash_paths import deduplicated
from quire.llm.mixing import label_domains, mix, text_hash
from quire.llm.queries import VOCABULARY_FILE
from quire.llm.secrets import redact
from quire.llm.segment_sampling import load_vocabulary, sample_segmentations
from quire.plans.registry import table
from quire.session import scratch_path

#: Token shares aimed at; the clean domain is wanted just as it is, the others thinned or repeated.
MIXTURE = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}
#: From this posterior on a document is clean and stays as it is.
CLEAN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null text, no letter); fill a missing ``lang``."""
    profiles = fit_profiles(docs.where(fold("doc_id", 4) != 2))
    found = predict_language(F.col("text").cast("string"), profiles)
    kept = docs.withColumn("_found", found).where(F.col("_found.lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "_found.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of smallest doc_id; all without words.

    Rows are judged by id and text: an unlike text under a dropped or kept id stays, a
    row that repeats both goes.
    """
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts; no document is dropped."""
    return redact(docs, scratch_path(spark, "secret-ledger"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the domains to their target shares: every row as often as its rate says.

    A row stands in the result as many times as the operator made copies of it, 0 or
    more.  Rows more likely clean than not stay just as they are, and the rates of the
    others are fitted around them.
    """
    mixed = mix(docs, label_domains(table(spark, sf_dir, "labels")), MIXTURE, keep="clean",
                hold=CLEAN, by_text=True)
    # equal texts of one id are judged alike
    judged = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.max("copies").alias("_copies")).where("_copies > 0")
    rows = docs.hint("merge").join(judged, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
                                   & (text_hash() == F.col("_hash")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))) \
        .select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with inclusion scores."""
    found = sample_segmentations(docs, load_vocabulary(VOCABULARY_FILE), k=2)
    return found.select(F.col("key").alias("doc_id"), "rank", "log_prob", "log_inclusion",
                        "exact", F.size("ids").alias("n_pieces"), "ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("secrets", secrets), ("mixing", mixing), ("segmentation", segmentation)]
#: Learned profiles, sampled posteriors and segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents of ``sf_dir``, each reread from Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
