"""A stored vector index: cells of a k-means, blocks of vectors by cell, and searches that join queries to cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators.dense import best_of_pairs
from ravelin.sources.scratch import Scratch

#: At most so many cells, so that their centres may go to every task; so many vectors at most are looked at to place
#: them; a stored block has so many vectors, a packed row of queries so many queries.
MOST_CELLS, TRAIN_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 4096, 100_000, 2048, 512
#: How many cells a search looks into is measured when an index is built: as many as so many of its vectors, asked for
#: so many neighbours each, need to find this share of them.
TRIALS, TRIAL_K, TARGET_RECALL = 200, 20, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """An index as it lies in its folder. ``cells`` (cell, centre, radius, count) is small; ``blocks`` (cell, block, ids,
    vectors) has every vector once, as float32 rows one after the other."""

    spark: SparkSession
    path: str
    dim: int
    count: int
    cells: int
    probes: int
    model: str

    @property
    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def cell_count(n: int) -> int:
    """As many cells as a cell has vectors, within the bound."""
    return max(1, min(MOST_CELLS, round(math.sqrt(n))))


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _train(vectors: DataFrame, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if cells == 1:  # one cell lies around the mean
        means = vectors.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
        return np.array([[r.m for r in means]])
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(some)
    return np.array(model.clusterCenters(), np.float64)


def _assign(centres: np.ndarray):
    """The nearest centre of every vector, and how far it is."""
    half = (centres**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                own = _rows(part.column(1))
                cell = np.argmax(own @ centres.T - half, axis=1)
                far = np.sqrt(((own - centres[cell]) ** 2).sum(1))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    return run


def _packed(name: str):
    """The rows of a group as one row: their ids, and their vectors as float32."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        matrix = _rows(rows.column("v")).astype("<f4")
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([matrix.tobytes()], pa.binary())})

    return run


def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, model: str = "", target_recall: float = TARGET_RECALL, seed: int = 42) -> VectorIndex:
    """Writes the index of ``vectors`` to ``path`` and opens it.

    Centres are placed by k-means over at most ``TRAIN_ROWS`` vectors, those of the least hash of their id; every vector
    is stored, in the cell of its nearest centre. A cell of more than ``BLOCK_ROWS`` vectors has several blocks, so a
    cell that holds a third of all rows is as many groups as any others of that size together. How many cells a search
    looks into follows from ``target_recall``: few where vectors lie in clusters, most of them where they do not. Rows
    without id or vector are left out; vectors have one length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if size.low != size.high:
        raise ValueError("vectors have different lengths")
    if cells is not None and not 0 < cells <= MOST_CELLS:
        raise ValueError(f"an index has 1 to {MOST_CELLS} cells")
    centres = _train(rows, cells or cell_count(size.n), seed) if size.n else np.zeros((1, 1))
    scratch = Scratch(spark, "vector-index")
    placed = scratch.write(rows.mapInArrow(_assign(centres), "id long, v array<float>, cell int, far double"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("count"), F.max("far").alias("radius"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    named.join(sizes, "cell", "left").na.fill(0, ["count", "radius"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select("cell", F.ceil(F.col("count") / BLOCK_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    dealt.select("cell", "block", "id", "v").groupBy("cell", "block").applyInArrow(_packed("block"), "cell int, block long, ids array<long>, vectors binary").write.mode("overwrite").parquet(f"{path}/blocks")
    index = VectorIndex(spark, path, int(size.high or 0), int(size.n), len(centres), len(centres), model)
    if size.n:
        trials = placed.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(TRIALS).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"))
        index = replace(index, probes=_probes(index, scratch.write(trials, "trials"), target_recall))
    config = [(index.dim, index.count, index.cells, index.probes, model)]
    spark.createDataFrame(config, "dim int, count long, cells int, probes int, model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    scratch.drop("placed", "trials")
    return open_index(spark, path)


def _probes(index: VectorIndex, trials: DataFrame, target: float) -> int:
    """How many of its nearest cells a query has to look into, on average over ``trials``."""
    centres = np.array([r.centre for r in index.centres.orderBy("cell").collect()])
    truth = search(index, trials, TRIAL_K, index.cells).join(index.blocks.select("cell", F.explode("ids").alias("id")), "id").select("q", "cell")
    asked = trials.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = asked.mapInArrow(_cells_of(centres, np.zeros(len(centres)), index.cells, 0), PROBED).select(F.col("id").alias("q"), "cell", "place")
    places = truth.join(near, ["q", "cell"]).groupBy("place").count().orderBy("place").collect()  # a row a cell at most
    total, reached = sum(r["count"] for r in places), 0
    for r in places:
        reached += r["count"]
        if reached >= target * total:
            return r.place + 1
    return index.cells


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A written index; one whose blocks do not have as many vectors as it says is refused."""
    found = spark.read.parquet(f"{path}/config").first()
    n = spark.read.parquet(f"{path}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n if found["count"] else 0
    if n != found["count"]:
        raise ValueError(f"{path} has {n} vectors instead of {found['count']}")
    return VectorIndex(spark, path, found.dim, found["count"], found.cells, found.probes, found.model)


PROBED = "id long, v array<float>, cell int, place int"


def _cells_of(centres: np.ndarray, radii: np.ndarray, probes: int | None, start: int):
    """(id, v, cell, place) of the cells that a query looks into: those from place ``start`` to ``probes`` by inner product with
    the centre; without ``probes``, those from there on that can hold a vector as good as ``least`` (a third column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_QUERIES):
                part = batch.slice(lo, BLOCK_QUERIES)
                asked = _rows(part.column(1))
                near = asked @ centres.T
                place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                if probes is not None:
                    wanted = (place >= start) & (place < probes)
                else:  # of a vector x in a cell: q.x = q.centre + q.(x - centre), at most q.centre + |q| radius
                    most = near + np.sqrt((asked**2).sum(1))[:, None] * radii
                    wanted = (place >= start) & (most + 1e-5 * (1 + np.abs(most)) >= part.column(2).to_numpy()[:, None])
                row, cell = np.nonzero(wanted)
                yield pa.record_batch([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(place[row, cell], pa.int32())], names=["id", "v", "cell", "place"])

    return run


def _looked_up(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(q, id, score): the k best of each query in each block of its cells (id, v, cell)."""
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("parts"))
    chunks = asked.join(F.broadcast(many), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts"))).select("cell", "chunk", "id", "v")
    packed = chunks.groupBy("cell", "chunk").applyInArrow(_packed("chunk"), "cell int, chunk long, ids array<long>, vectors binary")
    pairs = packed.select("cell", F.col("ids").alias("qs"), F.col("vectors").alias("asked")).join(index.blocks, "cell")
    return pairs.select("qs", "asked", "ids", "vectors").mapInArrow(best_of_pairs(k, "<f4"), "q long, id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False, query_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(q, id, score, rank) by inner product; ties by the smaller id.

    Queries look into ``probes`` cells (as many as the index has found to be enough, if not given), those whose centres
    have the highest inner product with the query. With ``exact`` they then look into every other cell that can hold a better vector than
    their k-th so far, as its radius tells, and the result is that of comparing all. Queries and blocks meet in a join
    on the cell; each pair is one product of two matrices of bounded size. Queries without id or vector find nothing.
    """
    rows = index.centres.orderBy("cell").collect()  # MOST_CELLS at most
    centres, radii = np.array([r.centre for r in rows]), np.array([r.radius for r in rows])
    empty = np.array([r["count"] for r in rows]) == 0
    probes = probes or index.probes
    asked = queries.select(F.col(query_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    if not index.count:
        return asked.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = _looked_up(index, asked.mapInArrow(_cells_of(centres, radii, probes, 0), PROBED), k)
    if exact:
        radii = np.where(empty, -np.inf, radii)
        best = top(found)
        least = best.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("least"))
        more = asked.join(least, "id", "left").select("id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        rest = more.mapInArrow(_cells_of(centres, radii, None, probes), PROBED)
        found = best.select("q", "id", "score").unionByName(_looked_up(index, rest, k))
    return top(found)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, recall): how much of the true hits (q, id) of each query was found."""
    hits = truth.select("q", "id").join(found.select("q", "id").withColumn("hit", F.lit(1)), ["q", "id"], "left")
    return hits.groupBy("q").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))
