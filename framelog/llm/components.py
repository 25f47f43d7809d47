"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Edges stay distributed; each round is two aggregations and two joins and ends in a checkpoint. A node with very many edges is
handled by partial aggregation and by the skew handling of the adaptive joins. The number of rounds grows with the logarithm of the
largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down, or edges up and down: then every component is its least node and the others around it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select("b", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
    return ends.where("down > 1 or (down = 1 and all > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs) except the roots themselves; root is the least node of its component.

    Self-loops, repeated edges, both directions and edges with a null end are allowed and add nothing. No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(e)
    while not _are_stars(e):
        e = checkpoint(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
