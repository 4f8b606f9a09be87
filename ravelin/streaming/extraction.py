"""Extraction from a stream of chunks, once for each: results by batch, a ledger, and a breaker that outlives a run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RESULTS = "chunk_id string, raw string, batch long"
LEDGER = "batch long, success long, failed long, failures long, seconds double"


class BreakerOpen(RuntimeError):
    """Too many failures in a row: the batch at hand was not begun and will be the next run's first."""


@dataclass(frozen=True)
class ExtractionStore:
    """Results (chunk_id, raw; null where the model failed) and a ledger, a folder each with one part a batch. Writing a
    batch again replaces its parts, so a batch that was cut short and comes again leaves no row twice."""

    spark: SparkSession
    path: str
    most_failures: int = 20

    def _read(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return self.spark.read.schema(schema).parquet(where)

    def results(self) -> DataFrame:
        return self._read("results", RESULTS)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def open_chunks(self, chunks: DataFrame) -> DataFrame:
        """Chunks without a result: those that failed, and those that no batch has had."""
        return chunks.join(self.results().where("raw IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")

    def failures(self) -> int:
        """Calls that have failed since the last success, over all batches."""
        last = self.ledger().orderBy(F.desc("batch")).first()
        return last.failures if last else 0

    def next_batch(self) -> int:
        return (self.ledger().agg(F.max("batch").alias("n")).first().n or 0) + 1

    def extract(self, chunks: DataFrame, batch: int, extract: Callable[[DataFrame], DataFrame]) -> dict[str, float]:
        """One batch: what has no result yet is extracted and written in one job, whose counts are observed as it runs."""
        before = self.ledger().where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
        failures = before.failures if before else 0
        if failures >= self.most_failures:
            raise BreakerOpen(f"{failures} calls have failed in a row")
        earlier = self.results().where((F.col("batch") != batch) & F.col("raw").isNotNull()).select("chunk_id")
        todo = chunks.dropDuplicates(["chunk_id"]).join(earlier, "chunk_id", "left_anti")
        seen, began = Observation(), time.monotonic()
        counted = extract(todo).select("chunk_id", "raw").observe(seen, F.count_if(F.col("raw").isNotNull()).alias("success"), F.count_if(F.col("raw").isNull()).alias("failed"))
        counted.write.mode("overwrite").parquet(f"{self.path}/results/batch={batch}")
        success, failed = (int(seen.get[k] or 0) for k in ("success", "failed"))
        row = {"success": success, "failed": failed, "failures": 0 if success else failures + failed, "seconds": time.monotonic() - began}
        self.spark.createDataFrame([tuple(row.values())], LEDGER.partition(", ")[2]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        return row

    def reset_breaker(self) -> None:
        """Begin again after the cause of the failures is gone: an entry of the ledger without failures."""
        batch = self.next_batch() - 1
        last = self.ledger().where(F.col("batch") == batch).first()
        if last:
            self.spark.createDataFrame([(last.success, last.failed, 0, last.seconds)], LEDGER.partition(", ")[2]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def progress(self, total: int) -> dict[str, float]:
        """Totals of all batches, chunks a second and seconds to go, from the ledger alone."""
        r = self.ledger().agg(F.coalesce(F.sum("success"), F.lit(0)).alias("success"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")).first()
        rate = (r.success + r.failed) / r.seconds if r.seconds else 0.0
        return {"success": r.success, "failed": r.failed, "rate": round(rate, 4), "eta": round((total - r.success) / rate, 1) if rate else 0.0}


def extract_stream(chunks: DataFrame, store: ExtractionStore, extract: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """All chunks of a file stream that are there now. Each batch is one of the store, by the stream's own number, so
    a run that was killed takes up the batch it was in. An open breaker ends the run before the next batch."""
    run = chunks.writeStream.foreachBatch(lambda df, n: store.extract(df, n, extract)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
