"""Connected components of an edge table, by alternating stars.

Large star: every larger neighbour of a node is linked to the smallest of its
neighbours; small star: every smaller neighbour and the node itself are. Rounds
grow with the logarithm of the number of nodes; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def _star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # tables joined to are written first: so Spark can split a node that has very many edges
    least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(low, "a")
    out = scratch.write(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    for done in (least, large, low):
        scratch.drop(done)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long) -> node, root (the smallest node of its component) of every node that has an edge to another."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        then = now
        now = _star(then, scratch)
        # done when every node has one edge, and that to a node that has none
        state = now.groupBy("a").agg(F.count("*").alias("n"))
        loose = now.join(state.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() + state.where("n > 1").limit(1).count()
        scratch.drop(then)
        if not loose:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
