"""Connected components of links by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all nodes with an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops and
    repeats do no harm. Every round points each node's larger, then its smaller
    neighbours to the smallest node next to it, until only stars are left:
    about log2(n) rounds squared at worst, a few in practice. All steps are
    aggregates with a partial stage and joins that can be split, so a node with
    very many neighbours isn't gathered anywhere.
    """
    up = F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")
    stars = saved(edges.where(F.col("a") != F.col("b")).select(*up).distinct(), "stars")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = saved(large.where("node != to").distinct(), "large-stars")
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(least, "node")
        small = small.select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(least.select("node", F.col("least").alias("to")))
        stars = saved(small.where("node != to").distinct(), "stars")
    centres = stars.select(F.col("to").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select("node", F.col("to").alias("component")).unionByName(centres)


def _are_stars(stars: DataFrame) -> bool:
    twice = stars.groupBy("node").count().where("count > 1").limit(1)
    inner = stars.select("node").join(stars.select(F.col("to").alias("node")).distinct(), "node", "left_semi").limit(1)
    return twice.isEmpty() and inner.isEmpty()
