"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (large) or smaller (small) neighbours of every node to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every child (a) has one parent (b) that is no child itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c = 1 and p = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Neighbours are only minimised and joined, never collected, so a node with a
    third of all edges is no hot group. The loop ends when the edges are stars
    around least nodes; that is one aggregate, of which only a flag reaches the driver.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    while not _stars(now):
        now = cut(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
