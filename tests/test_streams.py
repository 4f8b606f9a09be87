"""Streams against the batch results over the same rows: after a restart, with late rows, with expiry."""

import time

import pytest
from pyspark.sql import functions as F

from ravelin.operators import memory
from ravelin.streaming import jobs, sessions

MESSAGES = "conv_id long, turn long, role string, text string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sessions.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def talk(spark, turns, convs=(1, 2, 3)):
    return spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"m{t} of {c}") for c in convs for t in turns], MESSAGES)


def run(stream, sink, checkpoint):
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merger():
    """A function that goes to the workers by value, as they do not have this module."""
    return lambda old, lines: "\n".join([x for x in [old] if x] + lines)


def last(spark, sink):
    rows = spark.read.parquet(sink).groupBy("conv_id").agg(F.max_by(F.struct("summary", "cursor"), F.struct("cursor", F.length("summary"))).alias("x"))
    return {r.conv_id: (r.x.summary, r.x.cursor) for r in rows.collect()}


def test_summaries_after_a_restart_are_those_of_the_batch(rocks, tmp_path):
    spark, path, sink = rocks, str(tmp_path / "m"), str(tmp_path / "out")
    stored = spark.createDataFrame([(1, "before", 2)], "conv_id long, summary string, cursor long")
    source = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(path)
    for turns in (range(1, 6), range(6, 11)):
        talk(spark, turns).coalesce(1).write.mode("append").parquet(path)
    run(sessions.rolling_summaries(source(), merger(), stored=stored), sink, str(tmp_path / "c"))
    talk(spark, [9, 10, 11, 12, 13]).coalesce(1).write.mode("append").parquet(path)  # two of them again
    run(sessions.rolling_summaries(source(), merger(), stored=stored), sink, str(tmp_path / "c"))
    every = talk(spark, range(1, 14))
    batch = memory.summarise(memory.pending_summary(every, stored), stored, lambda p: p).collect()
    expected = {r.conv_id: (r.summary.strip(), r.cursor) for r in batch}
    assert last(spark, sink) == expected and expected[1][0].startswith("before\nuser: m3")


def test_idle_sessions_end(rocks, tmp_path):
    spark, path, sink = rocks, str(tmp_path / "m"), str(tmp_path / "out")
    talk(spark, range(1, 4), [7]).coalesce(1).write.parquet(path)
    stream = sessions.rolling_summaries(spark.readStream.schema(MESSAGES).parquet(path), merger(), idle_ms=1)
    write = lambda df, n: df.write.mode("append").parquet(sink)
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        ended, until = [], time.monotonic() + 60
        while not ended and time.monotonic() < until and query.exception() is None:
            time.sleep(1)
            ended = [tuple(r) for r in spark.read.schema(sessions.OUTPUT).parquet(sink).where("ended").collect()] if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert ended == [(7, "user: m1 of 7\nassistant: m2 of 7\nuser: m3 of 7", 3, True)]


def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


def test_traces_sent_twice_count_once(spark, small, tmp_path):
    path = str(tmp_path / "e")
    rows = events(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = [r[0] for r in rows.selectExpr("percentile_approx(ts, array(0.5D))").collect()][0][0]
    rows.where(F.col("ts") <= cut).coalesce(1).write.parquet(path)
    rows.where((F.col("ts") > cut - F.expr("INTERVAL 5 MINUTES"))).coalesce(1).write.mode("append").parquet(path)  # overlaps
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.distinct_traces(source).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == rows.count() and spark.table("once").select("event_id").distinct().count() == rows.count()
    rows.orderBy("ts").limit(3).coalesce(1).write.mode("append").parquet(path)  # far behind the watermark
    query = jobs.distinct_traces(source).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert jobs.dropped_as_late(query) == 3


def test_questions_and_outcomes(spark, small, tmp_path):
    rows = events(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())[:2]
    for name, kind in zip(("q", "o"), kinds):
        own = rows.where(F.col("event_type") == kind).select("user_id", "ts")
        own.coalesce(1).write.parquet(str(tmp_path / name))
    user = rows.schema["user_id"].dataType.simpleString()
    source = [spark.readStream.schema(f"user_id {user}, ts timestamp").parquet(str(tmp_path / n)) for n in ("q", "o")]
    query = jobs.answered(*source).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    q, o = (rows.where(F.col("event_type") == k).select("user_id", F.col("ts").alias(n)) for k, n in zip(kinds, ("a", "b")))
    expected = q.join(o, "user_id").where("b >= a AND b <= a + INTERVAL 30 MINUTES").select("user_id", "a", "b")
    found = spark.table("answers").where("answered_at IS NOT NULL").select("user_id", "asked_at", "answered_at")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    end = min(q.agg(F.max("a")).first()[0], o.agg(F.max("b")).first()[0])  # the slower side holds the watermark back
    none = q.where(F.col("a") < F.lit(end) - F.expr("INTERVAL 45 MINUTES")).join(expected.select("user_id", "a"), ["user_id", "a"], "left_anti")
    lonely = spark.table("answers").where("answered_at IS NULL").select("user_id", F.col("asked_at").alias("a"))
    assert lonely.count() > 0 and lonely.join(expected.select("user_id", "a"), ["user_id", "a"]).count() == 0
    assert none.exceptAll(lonely).count() == 0
