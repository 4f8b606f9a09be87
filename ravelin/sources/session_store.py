"""Sessions and messages as stored tables that change: only the partitions that a change touches are written again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import memory
from ravelin.sources.scratch import Scratch

#: Parts that sessions are dealt over. A table keeps the number that it was made with.
BUCKETS = 64
SESSIONS = "session_id string, title string, summary string, cursor long, created_at timestamp, updated_at timestamp"
MESSAGES = "session_id string, turn long, role string, text string, created_at timestamp"
#: What a row is known by: a change replaces the rows of its keys.
KEYS = {"sessions": ["session_id"], "messages": ["session_id", "turn"]}


@dataclass(frozen=True)
class SessionStore:
    """Two tables in ``path``, each partitioned by a hash of the session. Changes are merged by key, so that one that is
    made again leaves what is there; they take one writer at a time."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{SESSIONS if name == 'sessions' else MESSAGES}, bucket int").parquet(self._folder(name))

    def _folder(self, name: str) -> str:
        where = f"{self.path}/{name}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return where

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int"))

    def _change(self, name: str, keys: DataFrame, rows: DataFrame | None, by: list[str]) -> None:
        """Rows whose ``by`` stands in ``keys`` give way to ``rows``. The new partitions are written aside, as they are
        made of the old ones, and then take their places; one that has no rows left goes."""
        scratch = Scratch(self.spark, "session-change")
        keys = scratch.write(self._dealt(keys.select(*by).distinct()), "keys")
        touched = sorted(r.bucket for r in keys.select("bucket").distinct().collect())  # BUCKETS at most
        if not touched:
            return
        old = self.table(name)
        after = old.where(F.col("bucket").isin(touched)).join(keys.drop("bucket"), by, "left_anti").select(old.columns)
        if rows is not None:
            after = after.unionByName(self._dealt(rows).select(old.columns))
        after = scratch.write(after, "after")
        after.repartition("bucket").sortWithinPartitions(*KEYS[name]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._folder(name))
        left = {r.bucket for r in after.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(name)}/bucket={bucket}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        scratch.drop("keys", "after")

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows by their keys: new ones come in, those that are there are replaced. Columns that are left out are null;
        of several rows of one key, one is taken."""
        known = SESSIONS if name == "sessions" else MESSAGES
        full = rows.sparkSession.createDataFrame([], known).unionByName(rows.select(*[c for c in rows.columns if c in known]), allowMissingColumns=True).dropDuplicates(KEYS[name])
        full = Scratch(self.spark, "session-rows").write(full, "rows")
        self._change(name, full, full, KEYS[name])

    def add_messages(self, messages: DataFrame) -> None:
        """Messages come in, and their sessions follow: new ones are made, one without a title gets that of its first
        message if a user sent it, and the time of the last message is that of its last change."""
        self.put("messages", messages)
        ids = messages.select("session_id").distinct()
        own = self.table("messages").join(ids, "session_id", "left_semi")
        times = own.groupBy("session_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        titles = memory.session_titles(own, "session_id").withColumnRenamed("title", "new_title")
        old = self.table("sessions").join(ids, "session_id", "left_semi").drop("bucket")
        merged = times.join(titles, "session_id").join(old, "session_id", "left")
        self.put("sessions", merged.select("session_id", F.coalesce("title", "new_title").alias("title"), "summary", "cursor", F.coalesce("created_at", "first").alias("created_at"), F.greatest("updated_at", "last").alias("updated_at")))

    def set_summaries(self, summaries: DataFrame) -> None:
        """Summary and cursor of (session_id, summary, cursor); a cursor never goes back, and an older summary with it."""
        new = summaries.select("session_id", F.col("summary").alias("new"), F.col("cursor").alias("to"))
        newer = F.col("cursor").isNull() | (F.col("to") >= F.col("cursor"))
        changed = self.table("sessions").drop("bucket").join(new, "session_id").where(newer)
        self.put("sessions", changed.withColumns({"summary": F.col("new"), "cursor": F.col("to")}).drop("new", "to"))

    def pending(self, n: int = memory.RECENT) -> DataFrame:
        """Messages that are to be summarised, behind the cursors of their sessions."""
        cursors = self.table("sessions").where("cursor IS NOT NULL").select("session_id", "cursor")
        return memory.pending_summary(self.table("messages").drop("bucket"), cursors, n, "session_id")

    def delete(self, sessions: DataFrame) -> None:
        """Sessions and their messages go."""
        for name in ("messages", "sessions"):
            self._change(name, sessions, None, ["session_id"])
