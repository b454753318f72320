"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalframe.llm import common


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type: node, root (smallest node of its component),
    one row for each node of an edge.

    Alternates large-star and small-star: every node points its larger neighbours, then
    its smaller ones, at the smallest node it knows. Each round is stored, so that lost
    executors cost one round and plans do not grow; a star's many edges are summed by
    partial aggregation before they are dealt out."""
    now = common.store(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the join deals both sides out anew and can split a star's centre.
        least = common.store(spark, both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        # Large star: larger neighbours of a go to the smallest of a and its neighbours.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a's smaller neighbours, and a, go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        step = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, now = now, common.store(spark, step.distinct(), "edges")
        common.discard(spark, before, least)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one that has none itself: what both steps
    leave as it is, so that no further round is needed to see it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), (F.col("b") > F.col("a")).cast("int").alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.max("up").alias("up"))
    return not seen.where("out > 1 or (out = 1 and into = 1) or up = 1").head(1)
