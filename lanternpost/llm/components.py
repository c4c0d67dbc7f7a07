"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage


def _star(links: DataFrame, whole: bool) -> DataFrame:
    """One step over links (a > b).  ``whole`` looks at all neighbours of a node, else at smaller ones.

    Only the least neighbour of each node is aggregated; lists of neighbours are never built.
    """
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if whole else links
    least = sides.groupBy("a").agg(F.min("b").alias("least"))
    joined = sides.join(least, "a")
    if whole:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        return moved.distinct()
    moved = joined.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of an edge other than the least one of its component.

    Loops, repeated edges and nulls are ignored; no edges give no rows.  Every round is written
    to the shared folder, so lineage stays short and a lost executor costs a read.
    """
    a, b = F.col(left), F.col(right)
    links = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, state = storage.stored(links, "links"), None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if not now["n"] or now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        links = storage.stored(_star(_star(links, True), False), "links")
