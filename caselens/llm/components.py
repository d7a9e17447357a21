"""Connected components of links, by alternating large-star and small-star steps.

All steps are joins and aggregations on the links; nothing is gathered by node,
so a hub with any number of links is only a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import discard, written


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``links`` (a, b: long); to be discarded once read."""
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(spark, edges, "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, written(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    found._written_at = edges._written_at  # ``discard`` takes the links away
    return found
