"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import discard, materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node that has a link to another node.

    A round sends each link to its end with most work done by partial minima, so
    a node with very many links needs no task of its own; the number of rounds
    grows with the logarithm of the longest path. Each round is a written table.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "links")
    while not _all_stars(edges):
        before, edges = edges, materialize(small_star(large_star(edges)), "stars")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller end, or only larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.filter("down > 1 or down = 1 and up = 1").isEmpty()
