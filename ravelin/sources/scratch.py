"""Tables that cut lineage, in the folder that the cluster shares between driver and executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark 4.1: the shuffles of a query go when it has ended. What is written here is read again from its files only.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that executor and Python worker hand over at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Written tables of one run of an operator.

    ``write`` stores a DataFrame as Parquet and reads it again, so that lost executors cost no more than the stage
    at hand; the shuffles that made it go with it. ``drop`` removes tables that no later stage reads. ``batch_rows``
    bounds the record batches of Python functions over wide rows. ``write`` holds settings of the session while it
    runs: queries that run at the same time need sessions of their own (``spark.newSession()``).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        held = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
        before = {k: self.spark.conf.get(k, None) for k in held}
        try:
            for k, v in held.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is not None:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its owner clears the folder
            pass
