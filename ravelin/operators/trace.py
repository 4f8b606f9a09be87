"""Execution traces: their rows, latency by stage, retries, and windows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace_row(query: Column, mode: Column, latency: Column, **more: Column) -> Column:
    """A trace as a struct: time to the second, latencies rounded to four digits."""
    return F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        query.alias("query"),
        mode.alias("query_mode"),
        F.transform_values(latency, lambda _, v: F.round(v, 4)).alias("latency"),
        *(c.alias(n) for n, c in more.items()),
    )


def stage_latency(traces: DataFrame, stage: str = "event_type", value: str = "value") -> DataFrame:
    return traces.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("calls"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("slowest"))


def tumbling(events: DataFrame, size: str = "1 hour", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, kind, n, total) of fixed windows; works on batches and on streams with a watermark."""
    return events.groupBy(F.window(F.col(time).cast("timestamp"), size), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, kind, n, total) of windows that begin every ``slide``; each event counts in all that hold it."""
    return events.groupBy(F.window(F.col(time).cast("timestamp"), size, slide), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")


def retry_rate(traces: DataFrame, retries: Column, by: str = "query_mode") -> DataFrame:
    """(by, queries, retried, rate): how many traces were searched again."""
    again = F.count_if(retries > 0)
    return traces.groupBy(by).agg(F.count("*").alias("queries"), again.alias("retried"), F.round(again / F.count("*"), 6).alias("rate"))


def latency_sums(traces: DataFrame, key: str = "query", latency: str = "latency") -> DataFrame:
    """(key, stage, seconds, rounds): what the rounds of a query took together at each stage."""
    each = traces.select(key, F.explode(latency).alias("stage", "seconds"))
    return each.groupBy(key, "stage").agg(F.round(F.sum("seconds"), 4).alias("seconds"), F.count("*").alias("rounds"))


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", who: str = "user_id") -> DataFrame:
    return events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap), who).agg(F.count("*").alias("n")).select(who, F.col("session_window.start").alias("session_start"), "n")
