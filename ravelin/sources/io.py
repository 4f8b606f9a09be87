"""Readers and writers: books, JSON lines, lexicons, vectors, graph and vector exports, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.order import numbered

CHUNK_SCHEMA = "chunk_id string, book string, chapter string, chapter_idx int, chunk_idx int, text string, char_count int"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, text): one text file is one book, named by its stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]*)\.txt$", 1).alias("book"), F.col("value").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_lines(spark: SparkSession, path: str, schema: str, lenient: bool = False, optional: bool = False) -> DataFrame:
    """JSON lines. ``lenient`` skips malformed lines, else they raise; with ``optional`` a missing path is empty."""
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def processed_ids(spark: SparkSession, path: str, id_col: str = "chunk_id") -> DataFrame:
    """Ids that an earlier run has written; none if there was none."""
    return read_json_lines(spark, path, f"{id_col} string", lenient=True, optional=True).where(F.col(id_col).isNotNull()).select(id_col).distinct()


def unprocessed(chunks: DataFrame, done: DataFrame, limit: int | None = None, order: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Chunks that are not done; a limit takes the first in order before that."""
    first = chunks if limit is None else chunks.orderBy(order or id_col).limit(limit)
    return first.join(done, id_col, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_lexicon(spark: SparkSession, path: str, extra: list[str] | None = None) -> list[str]:
    """Words of a file, one a line, blank lines left out, with ``extra``. A lexicon is small by its nature; beyond a
    million words it is refused rather than gathered."""
    words = spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").distinct()
    if words.limit(1_000_001).count() > 1_000_000:
        raise ValueError("a lexicon has a million words at most; join larger ones")
    return sorted({r.w for r in words.collect()} | set(extra or []))


def read_settings(path: str) -> dict[str, str]:
    """``KEY=value`` lines; comments and blank lines left out, quotes taken off. Callers let the environment win."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as file:
        for line in file:
            key, equals, value = line.strip().partition("=")
            if equals and not key.startswith("#"):
                out.setdefault(key.strip(), value.strip().strip("'\""))
    return out


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_traces(traces: DataFrame, path: str | None) -> str | None:
    """Append traces; without a path logging is off and nothing happens."""
    if path is None:
        return None
    traces.write.mode("append").json(path)
    return path


def write_vectors(df: DataFrame, path: str, vector_col: str, model: str) -> None:
    """Rows with their vectors, and beside them a table of size, model and count."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.agg(F.count("*").alias("count"), F.max(F.size(vector_col)).alias("dim")).withColumn("model", F.lit(model)).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, config) of a written vector index; rows of another number than its config says are refused."""
    rows, config = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/config").first().asDict()
    verify_counts(spark, {f"{path}/rows": config["count"]})
    return rows, config


def read_graph(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Raw graph rows; of rows that repeat a key, the last one in ``order``."""
    return last_wins(read_json_lines(spark, path, schema, lenient=True, optional=True), key, order)


def graph_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One node per name of an entity or an end of a relation."""
    ends = relations.select(F.col("head").alias("name")).union(relations.select("tail")).distinct()
    own = entities.select("name", "type", "description").dropDuplicates(["name"])
    return ends.join(own, "name", "full_outer")


def graph_edges(relations: DataFrame) -> DataFrame:
    return relations.select("head", "relation", "tail").distinct()


def vector_collection(df: DataFrame, order: list[str], prefix: str, id_col: str | None = None, text_col: str | None = None, most_chars: int = 4096) -> DataFrame:
    """Rows as a vector store takes them: a number from 0 as key, an id where there is none, texts within 4096."""
    out = numbered(df, order, "pk")
    fallback = F.concat(F.lit(f"{prefix}_"), F.col("pk").cast("string"))
    out = out.withColumn("ext_id", F.coalesce(F.col(id_col).cast("string"), fallback) if id_col else fallback)
    return out.withColumn(text_col, F.substring(text_col, 1, most_chars)) if text_col else out


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the columns that newer ones have added."""
    return old.unionByName(new, allowMissingColumns=True)


def verify_counts(spark: SparkSession, expected: dict[str, int]) -> None:
    """Written tables have the rows they should have."""
    for path, n in expected.items():
        if (found := spark.read.parquet(path).count()) != n:
            raise ValueError(f"{path} has {found} rows instead of {n}")
