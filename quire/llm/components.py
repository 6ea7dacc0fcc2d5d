"""Connected components of a distributed edge list by repeated contraction.

Every round each vertex follows its closed neighbour of least hash; the edges
are renamed to those representatives and loops and repeats dropped, so the graph
shrinks geometrically and a star or a clique is gone after a few rounds.  Only
DataFrame joins and pre-aggregated groupings are used; nothing is collected
except the row count of the remaining edges (Parquet metadata).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every vertex that has an edge to another vertex.

    ``component`` is the smallest vertex reachable.  Null ends and loops are
    ignored; repeated and reversed edges count once; no edges give no rows.
    """
    left, right = F.least(a, b), F.greatest(a, b)
    current = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(left.cast("long").alias("a"), right.cast("long").alias("b")).distinct(),
        "edges")
    labels = None
    while not current.isEmpty():
        ends = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        parents = materialize(
            ends.groupBy(F.col("a").alias("node"))
            .agg(F.min_by("b", F.struct(F.xxhash64("b"), F.col("b"))).alias("near"))
            .select("node", F.when(
                F.struct(F.xxhash64("node"), F.col("node"))
                < F.struct(F.xxhash64("near"), F.col("near")), F.col("node"))
                .otherwise(F.col("near")).alias("parent")),
            "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            step = parents.select(F.col("node").alias("label"), F.col("parent").alias("next"))
            labels = materialize(
                labels.join(step, "label", "left")
                .select("node", F.coalesce("next", "label").alias("label")),
                "labels")
        pa = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        current = materialize(
            current.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges")
    if labels is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
