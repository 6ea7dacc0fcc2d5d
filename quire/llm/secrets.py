"""Secret scans with an incremental blob ledger (DataFrame functions only).

A version of a path is content-addressed by the SHA-256 of its UTF-8 bytes.  The
ledger is two Parquet tables below one folder: ``scanned(blob, rule)`` names the
pairs done, ``findings(blob, rule, kind, start, end)`` what they gave.  A run
scans only pairs of a blob and a rule version that ``scanned`` lacks, each blob
once however many paths hold it (where these are few, no other text is moved), appends, and joins the findings of all current
blobs back to every path.  Findings are written before the pairs are marked done
and read back distinct, so a run that dies between the two is simply repeated.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        text = "\n".join([self.kind, self.pattern, str(self.group), str(self.least)])
        return hashlib.sha256(text.encode()).hexdigest()[:16]


# fixed values: the three kinds every scan reports, in this order
BASE_RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|"
                   r"[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                   r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # a match takes the whole run, so a shorter run can be left out by the pattern itself
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo, text) -> (blob, rule, kind, start, end), spans in code points, end exclusive.

    The parts between the matches and the matches themselves alternate, so a
    running sum of their lengths gives every position.
    """
    found = [
        F.when(F.array_contains("todo", r.version) & F.col("text").rlike(r.pattern), F.struct(
            F.lit(r.version).alias("rule"), F.lit(r.kind).alias("kind"),
            F.lit(r.least).alias("least"),
            F.arrays_zip(
                F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)),
                            F.length).alias("size"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)),
                            F.length).alias("value")).alias("runs")))
        for r in rules]
    runs = (blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("m"))
            .select("blob", "m.rule", "m.kind", "m.least",
                    F.posexplode("m.runs").alias("at", "run")))
    upto = W.partitionBy("blob", "rule").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("run.gap") + F.coalesce("run.size", F.lit(0))).over(upto)
    return (runs.withColumn("end", end)
            .where("run.size IS NOT NULL AND run.value >= least")
            .select("blob", "rule", "kind", (F.col("end") - F.col("run.size")).alias("start"),
                    "end"))


#: Unseen blobs that are few enough to be sent to every task (64 characters each).
FEW_BLOBS = 100_000


def _ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing scanned yet
            raise
        return spark.createDataFrame([], schema)


def scan_secrets(versions: DataFrame, ledger: str, *, path: str = "doc_id", text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what is unseen and return ``(paths, findings)``.

    ``paths``: one row per row of ``versions`` with ``path`` and ``blob``; ``findings``:
    ``blob, kind, start, end`` of these rules for all blobs of ``versions``, whichever
    run found them.  A null text is the empty blob, null paths and repeated rows stay,
    other columns are ignored, an empty table gives no rows and scans nothing.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"),
                                content.alias("text"))
    paths = materialize(addressed.select("path", "blob"), "blob-paths")
    current = materialize(paths.select("blob").distinct(), "blobs")
    done = _ledger(spark, ledger, "scanned", "blob string, rule string")
    todo = materialize(
        current.select("blob", F.explode(F.array(*[F.lit(r.version) for r in rules]))
                       .alias("rule"))
        .join(done, ["blob", "rule"], "left_anti")
        .groupBy("blob").agg(F.collect_set("rule").alias("todo")), "unseen")
    unseen = todo.count()
    if unseen:
        texts = addressed
        if unseen <= FEW_BLOBS:  # texts seen before never enter the exchange
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        once = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
        _scan(once.join(todo, "blob"), rules).write.mode("append").parquet(
            f"{ledger.rstrip('/')}/findings")
        todo.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(
            f"{ledger.rstrip('/')}/scanned")
    known = _ledger(spark, ledger, "findings",
                    "blob string, rule string, kind string, start long, end long")
    findings = (known.where(F.col("rule").isin([r.version for r in rules])).distinct()
                .join(current, "blob", "left_semi").select("blob", "kind", "start", "end"))
    return paths, findings


def summarise(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings: counts of the base kinds, their span string, all spans in order."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    spans = F.sort_array(F.collect_list(F.struct(
        "start", order[F.col("kind")].alias("rank"), "end", "kind")))
    base = [r.kind for r in BASE_RULES]

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return (findings.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base], spans.alias("found"))
        .select("blob", *[f"n_{k}" for k in base], "found",
                joined(F.filter("found", lambda s: s["kind"].isin(base))).alias("base_spans"),
                joined(F.col("found")).alias("spans")))


def secret_report(versions: DataFrame, ledger: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    paths, findings = scan_secrets(versions, ledger)
    report = materialize(summarise(findings).drop("found"), "secret-report")
    none = F.lit("")
    return paths.join(report, "blob", "left").select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}")
          for r in BASE_RULES],
        F.sha2(F.coalesce("base_spans", none), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: str, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span found replaced by ``mask``, overlapping ones by one.

    Columns other than ``text`` (and ``n_chars``, recounted where it exists and the text
    changed) stay as they are, null texts too.
    """
    _, findings = scan_secrets(docs, ledger)
    found = materialize(summarise(findings).select(
        F.col("blob").alias("_blob"), F.col("found").alias("_found")), "redactions")
    cleaned = F.expr(f"""
        concat(array_join(transform(_found, (s, i) ->
            IF(s.start < coalesce(array_max(transform(slice(_found, 1, i), x -> x.end)), 0), '',
               concat(substring(text, CAST(coalesce(array_max(transform(slice(_found, 1, i),
                                                         x -> x.end)), 0) + 1 AS INT),
                                CAST(s.start - coalesce(array_max(transform(slice(_found, 1, i),
                                                         x -> x.end)), 0) AS INT)),
                      '{mask}'))), ''),
            substring(text, CAST(array_max(transform(_found, x -> x.end)) + 1 AS INT)))""")
    out = docs.withColumn("_blob", blob_id(F.col("text"))).hint("merge").join(
        found, "_blob", "left")
    changed = F.col("_found").isNotNull()
    out = out.withColumn("text", F.when(changed, cleaned).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            changed, F.length("text").cast(docs.schema["n_chars"].dataType))
            .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
