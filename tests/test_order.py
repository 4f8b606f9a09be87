"""Numbers in one order: whole and without gaps over many partitions, with adaptive execution."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin import catalogue
from ravelin.functions.order import numbered
from ravelin.operators import memory


def gaps(df, order, name):
    """Rows whose number is not one more than that of the row before."""
    return df.withColumn("_prev", F.lag(name).over(Window.orderBy(*order))).where(F.col(name) != F.coalesce(F.col("_prev") + 1, F.lit(0))).count()


def test_a_million_rows(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = spark.range(0, 1_000_000, 1, 16).select("id", F.xxhash64("id").alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # many small ranges, which adaptive execution merges
    try:
        out = numbered(rows, ["k"], "pk")
        assert out.count() == 1_000_000
        assert out.agg(F.min("pk"), F.max("pk"), F.countDistinct("pk")).first() == (0, 999_999, 1_000_000)
        assert gaps(out, ["k"], "pk") == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, None)], "k long, x string")
    assert sorted(r.n for r in numbered(rows, ["k"], "n").collect()) == [0, 1, 2, 3]
    assert numbered(rows, ["k"], "n").where("k IS NULL").first().n == 0
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_sessions_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        turns = spark.range(0, 200_000, 1, 16).select((F.col("id") % 50_000).alias("conv_id"), F.xxhash64("id").alias("turn"))
        out = memory.session_list(turns)
        assert out.agg(F.count("*"), F.min("place"), F.max("place"), F.countDistinct("place")).first() == (50_000, 1, 50_000, 50_000)
        assert gaps(out.withColumn("place", F.col("place") - 1), [F.desc("last"), "conv_id"], "place") == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_export_of_a_larger_table(spark):
    out = catalogue.QUERIES["export_vectors"](spark, "/root/testdata/sf0.1")
    assert out.agg(F.count("*"), F.min("pk"), F.max("pk"), F.countDistinct("pk")).first() == (10_000, 0, 9_999, 10_000)
