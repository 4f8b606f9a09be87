"""A stored inverted index for BM25: postings by term and block of documents, and searches that skip blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ravelin.functions import text as X
from ravelin.operators.bm25 import B, K1, idf
from ravelin.sources.scratch import Scratch

#: Documents of a block, folders of terms, and blocks of each query that are scored before any is skipped.
BLOCK_DOCS, BUCKETS, FIRST_BLOCKS = 64, 64, 8
#: Queries that are scored at a time, about: a task holds the weights of so many for the terms of one block.
DEAL_QUERIES = 1024
#: Folder of the rows that have no term: the documents of a block and their lengths.
NO_TERM = -1

Segment = Callable[[Column], Column]


@dataclass(frozen=True)
class InvertedIndex:
    """An index as it lies in its folder: ``postings`` (bucket, term, block, n, most_tf, least_dl, docs, tfs), by bucket of
    terms, and ``blocks`` (block, ids, dls), the documents of each block and their lengths. ``docs`` are places in these
    lists; ``most_tf`` and ``least_dl`` are over the ``n`` documents of the block that have the term."""

    spark: SparkSession
    path: str
    documents: int
    avgdl: float
    id_type: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_ROW}, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket") != NO_TERM)

    @property
    def blocks(self) -> DataFrame:
        rows = self.spark.read.schema(f"{_ROW}, ids array<{self.id_type}>, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket") == NO_TERM).select("block", "ids", F.col("tfs").alias("dls"))


_ROW = "term string, block long, n int, most_tf int, least_dl int, docs array<int>, tfs array<int>"


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(block_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of postings from (id, ws): the documents of a batch by length, so many to a block."""

    def rows(ids: pa.Array, ws: pa.Array, first: int) -> pa.RecordBatch:
        dl = pc.list_value_length(ws).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(dl, kind="stable")
        place = np.empty(len(dl), np.int64)
        place[order] = np.arange(len(dl))
        words = ws.flatten().dictionary_encode()
        size, docs = max(len(words.dictionary), 1), np.repeat(place, dl)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # One key for each (block, term, document), in this order.
        keys, tf = np.unique((docs // block_docs * size + code) * block_docs + docs % block_docs, return_counts=True)
        group, at = keys // block_docs, keys % block_docs
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        length = dl[order][group // size * block_docs + at]
        # Then a row for each block, without a term: its documents, and their lengths in place of frequencies.
        firsts = np.arange(0, len(dl), block_docs)
        no = pa.nulls(len(starts), pa.list_(ids.type)), pa.nulls(len(firsts), pa.string())
        lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values.cast(kind))
        i32 = lambda values: pa.array(values, pa.int32())
        reduced = lambda f, values: f.reduceat(values, starts) if len(starts) else values
        columns = {
            "term": (words.dictionary.take(pa.array(group[starts] % size)), no[1]),
            "block": (pa.array(first + group[starts] // size), pa.array(first + firsts // block_docs)),
            "n": (i32(np.diff(np.append(starts, len(keys)))), i32(np.diff(np.append(firsts, len(dl))))),
            "most_tf": (i32(reduced(np.maximum, tf)), i32(np.zeros(len(firsts)))),
            "least_dl": (i32(reduced(np.minimum, length)), i32(dl[order][firsts])),
            "docs": (lists(pa.array(at), starts, pa.int32()), lists(pa.array(np.arange(len(dl)) % block_docs), firsts, pa.int32())),
            "tfs": (lists(pa.array(tf), starts, pa.int32()), lists(pa.array(dl[order]), firsts, pa.int32())),
            "ids": (no[0], lists(ids.take(pa.array(order)), firsts, ids.type)),
        }
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns.values()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield rows(batch.column("id"), batch.column("ws"), block)
                block += -(-batch.num_rows // block_docs)

    return run


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None, segment: Segment | None = None, block_docs: int = BLOCK_DOCS) -> InvertedIndex:
    """Writes the index of ``docs`` to ``path`` and opens it.

    Texts are read and cut once, where they are: a task orders the documents of each batch by length and makes blocks
    of them, so that documents of a block have about one length and its bound says more. Only finished rows of postings
    move, once, to the folders of their terms. A row has one term in one block: a term that all documents have is as
    many rows as there are blocks. What depends on the whole corpus, the weight of a term and the mean length, is left
    to the search. Ids are unique and not null; an id that two rows share is an error. Null and empty texts count as
    documents of length 0.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), F.coalesce(X.tokens(F.col(text_col), stop_words, segment), F.array().cast("array<string>")).alias("ws"))
    rows = cut.mapInArrow(_blocks(block_docs), f"{_ROW}, ids array<{id_type}>").withColumn("bucket", F.coalesce(F.when(F.col("term").isNotNull(), _bucket()), F.lit(NO_TERM)))
    deals = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    dealt = rows.repartition("bucket", F.pmod("block", F.lit(deals))).sortWithinPartitions("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = InvertedIndex(spark, path, 0, 0.0, id_type).blocks.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("dls").alias("dl"))).alias("d")).select("d.id", "d.dl")
    twice = stored.groupBy("id").count().where("count > 1 OR id IS NULL").first()
    if twice:
        raise ValueError(f"id {twice['id']} stands in {twice['count']} rows")
    size = stored.agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl")).first()
    spark.createDataFrame([(size.n, float(size.avgdl or 0.0), id_type)], "documents long, avgdl double, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> InvertedIndex:
    found = spark.read.parquet(f"{path}/corpus").first()
    return InvertedIndex(spark, path, found.documents, found.avgdl, found.id_type)


def _wanted(queries: DataFrame, query_col: str, text_col: str, stop_words: list[str] | None, segment: Segment | None) -> DataFrame:
    cut = queries.select(F.col(query_col).alias("q"), F.explode(X.tokens(F.col(text_col), stop_words, segment)).alias("term"))
    return cut.groupBy("q", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", _bucket())


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _part(tf, dl, avgdl: float):
    """What a term of weight 1 adds to a score: more for a larger frequency and for a shorter document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _sums(avgdl: float, answer: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(q, id, score) of one block from its postings (docs, tfs, asking array<struct<q, weight>>) and its (ids, dls, qs):
    weights of queries by terms, times parts of terms by documents."""

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows or not block.num_rows:
            return answer.empty_table()
        ids, dls, qs = (block[c].combine_chunks().flatten() for c in ("ids", "dls", "qs"))
        docs, tfs, asking = (rows[c].combine_chunks() for c in ("docs", "tfs", "asking"))
        of_row = lambda lists: np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at, pairs = docs.flatten().to_numpy(), asking.flatten()
        parts = np.zeros((rows.num_rows, len(ids)))
        parts[of_row(docs), at] = _part(tfs.flatten().to_numpy().astype(float), dls.to_numpy()[at], avgdl)
        q = pc.fill_null(pc.index_in(pairs.field("q"), value_set=qs), -1).to_numpy()
        weights = np.zeros((len(qs), rows.num_rows))
        weights[q[q >= 0], of_row(asking)[q >= 0]] = pairs.field("weight").to_numpy()[q >= 0]
        scores = weights @ parts
        q, doc = np.nonzero(scores)
        return pa.table([qs.take(pa.array(q)), ids.take(pa.array(doc)), pa.array(scores[q, doc])], schema=answer)

    return run


def _scored(index: InvertedIndex, found: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, id, score) of the documents of (q, block) rows: a document is in one block, so its sum is whole.

    Postings that were found move by block and meet the queries there, so many queries at a time (``deal``)."""
    deals = (weights.agg(F.max("deal")).first()[0] or 0) + 1
    schema = T.StructType([weights.schema["q"], T.StructField("id", index.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    made = []
    for deal in range(deals):
        own = weights.where(F.col("deal") == deal)
        qs = blocks.join(own.select("q").distinct(), "q", "left_semi") if deals > 1 else blocks
        asked = qs.groupBy("block").agg(F.collect_set("q").alias("qs"))
        rows = found.select("term", "block", "docs", "tfs").join(asked.select("block"), "block", "left_semi").repartition("block")
        rows = rows.join(own.groupBy("term").agg(F.collect_list(F.struct("q", "weight")).alias("asking")), "term").select("block", "docs", "tfs", "asking")
        sums = _sums(index.avgdl, to_arrow_schema(schema))
        made.append(rows.groupBy("block").cogroup(index.blocks.join(asked, "block").groupBy("block")).applyInArrow(sums, schema))
    return reduce(DataFrame.unionByName, made).withColumn("score", F.round("score", 6)).where("score > 0")


def search(index: InvertedIndex, queries: DataFrame, k: int = 20, query_col: str = "item_id", text_col: str = "text", stop_words: list[str] | None = None, segment: Segment | None = None, first_blocks: int = FIRST_BLOCKS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, skipped): (q, id, score, rank) as ``bm25.top_k`` gives them, of equal scores the later document first; and
    (q, blocks, looked_into), how many blocks have a term of each query and in how many its documents were scored.

    The index is read once, and the postings of the queries' terms are written. A query's bound for a block is the sum of
    what its terms can add there, by their largest frequency and shortest document; these are read without the
    documents. Its best blocks by bound are scored, then all others whose bound reaches its k-th score so far. Blocks that
    cannot reach it are not scored.
    """
    scratch = scratch or Scratch(queries.sparkSession, "inverted-search")
    deals = -(-queries.count() // DEAL_QUERIES) or 1
    wanted = scratch.write(_wanted(queries, query_col, text_col, stop_words, segment).withColumn("deal", F.pmod(F.xxhash64("q"), F.lit(deals))), "wanted")
    found = scratch.write(index.postings.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi"), "found")
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    weights = scratch.write(wanted.join(df, "term").select("q", "bucket", "term", (F.col("qtf") * idf(F.lit(index.documents), F.col("df"))).alias("weight"), "deal"), "weights")
    most = F.col("weight") * _part(F.col("most_tf"), F.col("least_dl"), F.lit(index.avgdl))
    bound = found.select("term", "block", "most_tf", "least_dl").repartition("block").join(weights.select("q", "term", "weight"), "term").groupBy("block", "q").agg(F.sum(most).alias("bound"))
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    bounds = scratch.write(bound.withColumn("place", F.row_number().over(best)), "bounds")
    first = scratch.write(_ranked(_scored(index, found, weights, bounds.where(F.col("place") <= first_blocks)), k), "first")
    least = first.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    # Scores are rounded and summed in some order: a bound that falls short by less than that counts as reached.
    rest = bounds.where(F.col("place") > first_blocks).join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).select("q", "block")
    rest = scratch.write(rest, "rest")
    hits = _ranked(first.drop("rank").unionByName(_scored(index, found, weights, rest)), k)
    looked = bounds.where(F.col("place") <= first_blocks).select("q").unionByName(rest.select("q")).groupBy("q").agg(F.count("*").alias("looked_into"))
    return hits, bounds.groupBy("q").agg(F.count("*").alias("blocks")).join(looked, "q")
