"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node.

    Each step hangs nodes under the least neighbour they know, which needs
    O(log n) rounds. Nothing is collected: a round is two aggregates with
    map-side combine and two joins, written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Each node keeps its own least neighbour too, so that nothing is cut off.
        large = large.unionAll(least.filter("u > m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(star.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Done when all edges are stars: no node has two centres, or is a centre and hangs under one.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if ends.filter("out > 1 or (out > 0 and in > 0)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
