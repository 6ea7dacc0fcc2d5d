"""Mixing sources to target weights with soft membership (DataFrame functions only).

A naive Bayes classifier over hashed words, counted from labelled documents, gives
every document posteriors ``q_g`` over the domains.  With ``t`` a document's tokens
(words), rates ``r >= 0`` are fitted so that the expected domain totals
``S_g = sum r t q_g`` meet the targets ``T_g``: least squares of ``(S_g - T_g)^2 / m_g``,
where ``m_g`` is the domain's total at rate 1.  In the metric that weighs a document
by its tokens the gradient is ``sum_g q_g (S_g - T_g) / m_g`` and, as posteriors sum to
1, its Lipschitz constant is exactly 1, so every projected step is
``r <- max(0, r - gradient)``.  A step is one pass over a narrow table that sends as
many sums to the driver as there are domains.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

BINS = 1 << 14
LABELLED = 20_000
STEPS = 60
FUSED = 6
_WORDS = r"[ \t\n\x0B\f\r]+"


class TargetsNotMet(UserWarning):
    """The rates returned do not bring every domain to its target."""


def _words(rows: DataFrame) -> DataFrame:
    """One row per word with its bin; blank texts have none."""
    word = F.explode(F.filter(F.split(F.lower("text"), _WORDS), lambda w: w != ""))
    return rows.withColumn("word", word).withColumn(
        "bin", F.pmod(F.xxhash64("word"), F.lit(BINS)).cast("int")).drop("word", "text")


def fit_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], *,
                sample: int = LABELLED) -> tuple[DataFrame, list[float]]:
    """Log-likelihood ratios ``(bin, w_0, w_1, ...)`` per word bin, and log priors.

    ``labelled(doc_id, domain)``; about ``sample`` of its ids are used, taken by hash, and
    rows whose domain is null or not in ``domains`` are left out.  Counts are smoothed
    towards the overall word distribution by as many words as the smallest domain has,
    so a rare word says little.  At most ``BINS`` rows.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 20))
                         < int(share * (1 << 20)))
    index = F.create_map(*[F.lit(x) for k, d in enumerate(domains) for x in (d, k)])
    rows = docs.select("doc_id", "text").join(chosen.limit(2 * sample).hint("broadcast"),
                                              "doc_id")
    per_bin = materialize(
        _words(rows.select(index[F.col("domain")].alias("k"), "text")).groupBy("bin").agg(
            *[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in range(len(domains))]),
        "bin-counts")
    sums = per_bin.agg(*[F.sum(f"n_{k}") for k in range(len(domains))]).first()
    n = [float(x or 0) for x in sums]
    sizes = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    s = max(1.0, min([x for x in n if x] or [1.0]))
    rate = sum((F.col(f"n_{k}") for k in range(len(domains))), F.lit(0.0)) / max(1.0, sum(n))
    weights = per_bin.select("bin", *[
        F.log((F.col(f"n_{k}") + s * rate) / ((n[k] + s) * rate)).alias(f"w_{k}")
        for k in range(len(domains))])
    return weights, priors


def text_hash() -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def predict_domains(docs: DataFrame, weights: DataFrame, priors: list[float], *,
                    by_text: bool = False) -> DataFrame:
    """``doc_id, tokens, q_0, q_1, ...`` for every row; without words the priors.

    ``by_text`` adds ``text_hash`` after doc_id.
    """
    k = range(len(priors))
    names = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       *([text_hash().alias("text_hash")] if by_text else []),
                       F.col("text").cast("string").alias("text"))
    # explode_outer keeps rows without words; a bin never seen says nothing
    word = F.explode_outer(F.filter(F.split(F.lower("text"), _WORDS), lambda w: w != ""))
    words = rows.select("row", *names, word.alias("word")).withColumn(
        "bin", F.pmod(F.xxhash64("word"), F.lit(BINS)).cast("int"))
    logits = (words.join(F.broadcast(weights), "bin", "left").groupBy("row", *names)
              .agg(F.count("word").alias("tokens"),
                   *[F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col(f"w_{i}"))),
                                F.lit(0.0)).alias(f"l_{i}") for i in k]))
    logits = logits.select(*names, "tokens", *[(F.col(f"l_{i}") + priors[i]).alias(f"l_{i}")
                                               for i in k])
    top = F.greatest(*[F.col(f"l_{i}") for i in k]) if len(priors) > 1 else F.col("l_0")
    odds = logits.select(*names, "tokens", *[F.exp(F.col(f"l_{i}") - top).alias(f"o_{i}")
                                             for i in k])
    whole = sum((F.col(f"o_{i}") for i in k), F.lit(0.0))
    return odds.select(*names, "tokens", *[(F.col(f"o_{i}") / whole).alias(f"q_{i}")
                                           for i in k])


def fit_rates(members: DataFrame, targets: list[float], *, steps: int = STEPS,
              tolerance: float = 1e-6, held: Column | None = None) -> DataFrame:
    """Add ``rate`` to ``members(tokens, q_0, ...)``; ``targets`` are token totals per domain.

    Rows where ``held`` is true stay at rate 1; the others make up for them.

    Stops when every total is within ``tolerance`` of its target, as a share of all
    target tokens, or after ``steps``; a ``TargetsNotMet`` warning then says how far the
    totals are off, as it does where nobody belongs to a domain.
    """
    k = range(len(targets))

    def totals(frame: DataFrame, rate: Column) -> list[float]:
        row = frame.agg(*[F.sum(rate * F.col("tokens") * F.col(f"q_{i}")) for i in k]).first()
        return [float(x or 0.0) for x in row]

    mass = totals(members, F.lit(1.0))
    goal = sum(targets) or 1.0
    current = members.withColumn("rate", F.lit(1.0))
    have, fused = mass, 0
    for _ in range(steps):
        if max(abs(have[i] - targets[i]) for i in k) <= tolerance * goal:
            break
        gradient = sum((F.col(f"q_{i}") * F.lit((have[i] - targets[i]) / mass[i])
                        for i in k if mass[i] > 0), F.lit(0.0))
        moved = F.greatest(F.lit(0.0), F.col("rate") - gradient)
        current = current.withColumn(
            "rate", moved if held is None else F.when(held, 1.0).otherwise(moved))
        fused += 1
        if fused == FUSED:  # bounds the expression that later passes evaluate
            current, fused = materialize(current, "rates"), 0
        have = totals(current, F.col("rate"))
    if max(abs(have[i] - targets[i]) for i in k) > tolerance * goal:
        warnings.warn(f"after {steps} steps the domains hold {have} tokens, wanted {targets}",
                      TargetsNotMet, stacklevel=3)
    return current


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *,
        total: float | None = None, keep: str | None = None, hold: float | None = None,
        by_text: bool = False) -> DataFrame:
    """``doc_id, tokens, posteriors, rate, copies`` for every row of ``docs``.

    ``weights``: wanted share of each domain.  ``total``: wanted tokens in all; with
    ``keep`` instead, as many that domain ``keep`` is wanted just as it is; by default the
    tokens there are.  ``copies`` rounds the rate up or down by a hash of doc_id so that it
    is right on average.  Null or blank texts have no tokens and the prior posteriors;
    null and repeated ids stay, a repeated row counts each time; other columns are
    ignored; an empty table gives no rows.  Rows whose posterior in ``keep`` is at least
    ``hold`` stay at rate 1.  ``by_text`` adds ``text_hash`` after doc_id, so that rows of
    one doc_id can be told apart, and draws for rows of null doc_id by it.
    """
    domains = sorted(weights)
    names = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    model, priors = fit_weights(docs, labelled, domains)
    members = materialize(predict_domains(docs, model, priors, by_text=by_text), "members")
    sums = members.agg(*[F.sum(F.col("tokens") * F.col(f"q_{i}"))
                         for i in range(len(domains))]).first()
    have = [float(x or 0.0) for x in sums]
    share = [weights[d] / sum(weights.values()) for d in domains]
    if total is None:
        total = sum(have) if keep is None else have[domains.index(keep)] / share[
            domains.index(keep)]
    held = None if hold is None else F.col(f"q_{domains.index(keep)}") >= hold
    rated = fit_rates(members, [total * s for s in share], held=held)
    draw = F.pmod(F.xxhash64(F.lit("copies"), F.coalesce(*names)), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        *names, "tokens",
        F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"q_{i}"))])
        .alias("posteriors"), "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long"))
        .alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` as ``(doc_id, domain)``: toxic, junk or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))
