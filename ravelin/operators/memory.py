"""Sessions and messages: lists, titles, windows, pending summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.order import numbered

RECENT, TITLE_CHARS, LINE_CHARS = 6, 30, 300


def session_list(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, message_count, last, place): the latest first."""
    out = messages.groupBy(session).agg(F.count("*").alias("message_count"), F.max(order).alias("last"))
    return numbered(out, [F.desc("last"), F.col(session)], "place").withColumn("place", F.col("place") + 1)


def message_list(messages: DataFrame, sessions: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The messages of the given sessions, each with its place from 1; sorted by it within a session's partition."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long")
    return messages.join(sessions.select(session).distinct(), session, "left_semi").withColumn("place", place)


def session_titles(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, title): 30 characters of the first message and an ellipsis if a user sent it, null otherwise."""
    first = messages.groupBy(session).agg(F.min_by(F.struct("role", "text"), order).alias("m"))
    return first.select(session, F.when(F.col("m.role") == "user", F.concat(F.substring("m.text", 1, TITLE_CHARS), F.lit("..."))).alias("title"))


def _from_last(session: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))


def recent_window(messages: DataFrame, n: int = RECENT, session: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.withColumn("back", _from_last(session, order)).where(F.col("back") <= n)


def chat_history(messages: DataFrame, summaries: DataFrame | None = None, n: int = RECENT, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, place, role, text): the recent messages in order, after the session's summary, if any, as system."""
    rows = recent_window(messages, n, session, order).select(session, F.col(order).cast("long").alias("at"), "role", "text")
    if summaries is not None:
        rows = rows.unionByName(summaries.where("summary IS NOT NULL AND summary <> ''").select(session, F.lit(-1).cast("long").alias("at"), F.lit("system").alias("role"), F.col("summary").alias("text")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("at")).cast("long")).drop("at")


def pending_summary(messages: DataFrame, cursors: DataFrame | None = None, n: int = RECENT, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages to be summarised: all but the last ``n``, behind the session's cursor (session, cursor)."""
    rows = messages.withColumn("back", _from_last(session, order)).where(F.col("back") > n).drop("back")
    if cursors is None:
        return rows
    return rows.join(cursors, session, "left").where(F.col("cursor").isNull() | (F.col(order) > F.col("cursor"))).drop("cursor")


def summarise(pending: DataFrame, old: DataFrame, merge, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, summary, cursor) of sessions with pending messages: ``merge`` turns a prompt column of the old summary
    and the lines (300 characters of each) into a summary; a blank one leaves summary and cursor as they are."""
    line = F.concat_ws(": ", F.when(F.col("role") == "user", "user").otherwise("assistant"), F.substring("text", 1, LINE_CHARS))
    lines = pending.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"), F.max(order).alias("last"))
    joined = lines.join(old, session, "left")
    new = F.nullif(F.trim(merge(F.concat_ws("\n", F.coalesce("summary", F.lit("")), "lines"))), F.lit(""))
    return joined.withColumn("new", new).select(session, F.coalesce("new", "summary").alias("summary"), F.when(F.col("new").isNotNull(), F.col("last")).otherwise(F.col("cursor")).alias("cursor"))


def rewriter_history(messages: DataFrame, n: int = 4, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, history): the last ``n`` messages with content, whoever is no user shown as assistant."""
    rows = messages.where(F.coalesce(F.trim("text"), F.lit("")) != "").withColumn("back", _from_last(session, order)).where(F.col("back") <= n)
    line = F.concat_ws(": ", F.when(F.col("role") == "user", "user").otherwise("assistant"), "text")
    return rows.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def new_session(spark) -> DataFrame:
    return spark.range(1).select(F.substring(F.expr("uuid()"), 1, 8).alias("session_id"), F.current_timestamp().alias("created_at"))


def add_message(messages: DataFrame, message: DataFrame) -> DataFrame:
    return messages.unionByName(message, allowMissingColumns=True)


def touched(sessions: DataFrame, message: DataFrame, session: str = "session_id", time: str = "created_at") -> DataFrame:
    """Sessions with ``updated_at`` at their newest message, where there is one; else as it was, or at their making."""
    last = message.groupBy(session).agg(F.max(time).alias("_last"))
    old = F.col("updated_at") if "updated_at" in sessions.columns else F.col("created_at")
    return sessions.join(last, session, "left").withColumn("updated_at", F.greatest("_last", old)).drop("_last")


def delete_session(messages: DataFrame, gone: DataFrame, session: str = "conv_id") -> DataFrame:
    return messages.join(gone.select(session), session, "left_anti")
