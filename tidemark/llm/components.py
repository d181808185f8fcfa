"""Connected components of edge tables, as alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, settle


def starred(edges: DataFrame) -> bool:
    """Is every component a star already: each node with one parent at most, and no parent with a parent?"""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("n").agg(F.sum("child").alias("parents"), F.min("child").alias("child"))
    return seen.filter("parents > 1 or parents = 1 and child = 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of its component; nodes without an edge to another are left out. Settled.

    edges: (a, b) longs. Each round is two groupings with a join, written to the shared folder; rounds grow with the logarithm of the
    longest path, and end when all components are stars. A node with very many edges is a join key on one side only, which adaptive
    execution splits.
    """
    spark = edges.sparkSession
    now, path = settle(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not starred(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = settle(spark, large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old = path
        now, path = settle(spark, small, "edges")
        remove(spark, old, large_path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
