"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remove, written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    Each step is a min per node, which is combined before the shuffle, and a join of the
    edges with one row per node, whose hot partitions AQE splits.  A step's edges are a table
    in the shared folder; only the last one stays.  No edges: no rows.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    start = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = written(start, "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        small, small_path = written(small, "small")
        # done when every node points at a root that points nowhere itself
        open_roots = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        several = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        done = open_roots.isEmpty() and several.isEmpty()
        for gone in (path, large_path):
            remove(spark, gone)
        now, path = small, small_path
        release(spark)
        if done:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
