"""Numbers that follow one order over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.sources.scratch import Scratch


def numbered(df: DataFrame, order: list[str | Column], name: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the place of each row from 0 in ``order``.

    Rows are sorted over ranges and written once, each with the number of its partition and its place there; how many
    rows a partition has is counted from what was written. So no task sees all rows, and no plan has to give the same
    partitions twice: adaptive execution, or a task that runs again, cannot part a row from its number. The counts, a
    row for each partition, are small. Rows that tie keep one order, any.
    """
    scratch = scratch or Scratch(df.sparkSession, "numbered")
    stored = scratch.write(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}), f"sorted-{name}")
    counts = stored.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mono").alias("low"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "low", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return stored.join(F.broadcast(before), "_part").withColumn(name, F.col("offset") + F.col("_mono") - F.col("low")).drop("_part", "_mono", "low", "offset")
