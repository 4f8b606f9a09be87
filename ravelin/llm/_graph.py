"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node that is reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each round is two aggregations and two joins on a key
    whose other side is unique, so no neighbourhood is ever gathered in one task. Rounds are written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    mark, k = None, 0
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.write(large, f"cc{k}l")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = scratch.write(small, f"cc{k + 1}")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"cc{k}", f"cc{k}l")
        now, k = after, k + 1
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
