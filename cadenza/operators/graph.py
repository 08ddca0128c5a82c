"""Levels of small graphs, many at a time, by doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.shared import cut


def _doubled(now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ways (key, a, b, n) and all that two of them make; of several between two nodes the longest."""
    rest = now.select(*keys, F.col("a").alias("b"), F.col("b").alias("_end"), F.col("n").alias("_n"))
    longer = now.join(rest, [*keys, "b"]).select(*keys, "a", F.col("_end").alias("b"), (F.col("n") + F.col("_n")).alias("n"))
    return cut(now.unionByName(longer).groupBy(*keys, "a", "b").agg(F.max("n").alias("n")))


def levels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, level) of ``nodes`` (keys, node) with ``edges`` (keys, a, b): the length of the longest way that ends there.

    The level of a node on a cycle, or behind one, is null. Ways double in length every round, so a way of n
    edges takes log n rounds; a graph has at most a row for every two of its nodes.
    """
    first = edges.select(*keys, "a", "b", F.lit(1).cast("long").alias("n")).distinct()
    reach, pairs = cut(first.withColumn("n", F.lit(0).cast("long"))), -1
    while (size := reach.count()) != pairs:  # lengths of 0: only which nodes are reached
        pairs = size
        reach = _doubled(reach, keys)
    round_ = reach.filter(F.col("a") == F.col("b")).select(*keys, "a")
    lost = round_.unionByName(reach.join(round_, [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("a"))).distinct()
    lost = cut(lost.withColumnRenamed("a", "node"))
    now, total = cut(first.join(lost.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti").select(*keys, "a", "b", "n")), None
    now = cut(now.join(lost.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").select(*keys, "a", "b", "n"))
    state = lambda: now.agg(F.count(F.lit(1)), F.sum("n")).first()
    while (size := state()) != total:
        total = size
        now = _doubled(now, keys)
    level = now.groupBy(*keys, F.col("b").alias("node")).agg(F.max("n").alias("_n"))
    out = nodes.select(*keys, "node").join(level, [*keys, "node"], "left").join(lost.withColumn("_lost", F.lit(True)), [*keys, "node"], "left")
    return out.select(*keys, "node", F.when(F.col("_lost").isNull(), F.coalesce("_n", F.lit(0))).cast("int").alias("level"))
