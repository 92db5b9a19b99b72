"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stage


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the smallest node reachable.

    Each step points the larger neighbours of a node at the smallest one, so no
    task gathers a neighbourhood: a hub costs a minimum (combined before the
    shuffle) and a join whose hot side Spark can split.  Steps are written to
    the shared folder.  No edges give no rows; self-loops are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(spark, now, "cc")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.where("m < a").select("a", F.col("m").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stage(spark, small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(last)
