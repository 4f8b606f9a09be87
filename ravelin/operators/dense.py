"""Exact dense retrieval: blocks of queries against blocks of all vectors, partial top k of every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of one packed row.
BLOCK_QUERIES, BLOCK_ROWS = 512, 2048


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """To length one; a zero vector stays as it is."""
    n = norm(vector)
    return F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, vectors) of (id, v): so many rows as one, their numbers as doubles one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                own = np.asarray(part.column(1).flatten(), "<f8")
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([own.tobytes()], pa.binary())], names=["ids", "vectors"])

    return vectors.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "ids array<long>, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "vec_id", block: int = BLOCK_QUERIES) -> DataFrame:
    """(q, id, score, rank) by inner product, in double; ties by the smaller id.

    Every query is compared with every vector, as blocks: rows of ``block`` queries meet rows of ``BLOCK_ROWS`` vectors,
    and each pair is one product of two matrices, of which the k best of each query go on. Neither side passes the
    driver; a small set of queries goes to every task, by Spark's own measure. Where that is too much to compare,
    ``vector_index`` looks at the nearest cells first. Rows without id or vector are left out.
    """
    pack = lambda df, key, rows: _packed(df.select(F.col(key).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), rows)
    asked = pack(queries, query_col, block).select(F.col("ids").alias("qs"), F.col("vectors").alias("asked"))
    pairs = pack(vectors, id_col, BLOCK_ROWS).crossJoin(asked).select("qs", "asked", "ids", "vectors")
    out = pairs.mapInArrow(best_of_pairs(k, "<f8"), "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_pairs(k: int, kind: str):
    """Of rows (qs, asked, ids, vectors), packed queries and a packed block: the ``k`` best of every query in the block,
    by inner product in double, rounded to six places; ties by the smaller id. ``kind`` is that of the packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qs, ids = (batch.column(c)[row].values.to_numpy() for c in (0, 2))
                if not len(ids):
                    continue
                asked, own = (np.frombuffer(batch.column(c)[row].as_buffer(), kind).reshape(n, -1).astype(np.float64) for c, n in ((1, len(qs)), (3, len(ids))))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                scores = np.round(asked @ own[order].T, 6)
                if len(ids) > k:
                    # All that are as good as the k-th of their query, then of equals the smaller ids.
                    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                    q, at = np.nonzero(scores >= least[:, None])
                    value = scores[q, at]
                    sort = np.lexsort((at, -value, q))
                    q, at, value = q[sort], at[sort], value[sort]
                    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
                    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
                    q, at, value = q[keep], at[keep], value[keep]
                else:
                    q, at = np.divmod(np.arange(scores.size), len(ids))
                    value = scores.ravel()
                yield pa.record_batch([pa.array(qs[q]), pa.array(ids[at]), pa.array(value)], names=["q", "id", "score"])

    return run
