"""Rank fusion over routes, and what follows it: reranking, evidence, context, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as X

RRF_K = 60


def fuse(routes: list[tuple[str, float, DataFrame]], k: int = 10, rrf_k: int = RRF_K, keep_scores: bool = False) -> DataFrame:
    """(q, id, fused_score, rank, sources, first_score[, scores]) of weighted reciprocal rank fusion; ``scores`` maps
    every route that found a document to its own score.

    ``routes`` are (name, weight, (q, id, score, rank)) in order. Equal scores stand in the order of first appearance:
    route, then rank. ``sources`` are the routes that found a document, ``first_score`` is its score in the first.
    """
    rows = [df.select("q", "id", "score", "rank", F.lit(i).alias("route"), F.lit(name).alias("source"), F.lit(float(w)).alias("w")) for i, (name, w, df) in enumerate(routes)]
    part = F.col("w") / (rrf_k + F.col("rank"))
    grouped = reduce(DataFrame.unionByName, rows).groupBy("q", "id").agg(
        F.round(F.sum(part), 9).alias("fused_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("route", "source"))), lambda s: s["source"]), ",").alias("sources"),
        F.min(F.struct("route", "rank")).alias("seen"),
        F.min_by("score", "route").alias("first_score"),
        F.map_from_entries(F.collect_list(F.struct("source", F.col("score").cast("double")))).alias("scores"),
    )
    order = Window.partitionBy("q").orderBy(F.desc("fused_score"), "seen", "id")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "id", "fused_score", "rank", "sources", "first_score", *(["scores"] if keep_scores else []))


def rerank(hits: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """The ``k`` best of (q, id, rank, ...) by a model's score; ties stay in their order. Where the model is missing,
    pass a null score: the first ``k`` stay."""
    order = Window.partitionBy("q").orderBy(F.desc_nulls_last("rerank_score"), "old_rank")
    return hits.withColumnRenamed("rank", "old_rank").withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def contexts(hits: DataFrame, chunks: DataFrame, keep: int = 5) -> DataFrame:
    """(q, contexts array<struct<rank, id, book, chapter, text>>): bodies are joined after the top k; hits whose chunk
    is missing are left out."""
    some = hits.where(F.col("rank") <= keep).join(chunks, "id")
    return some.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "book", "chapter", "text"))).alias("contexts"))


def context_text(items: Column, most_chunks: int = 3, most_chars: int = 1200) -> Column:
    """Numbered sources of an answer within a budget of characters. A text beyond what is left is cut at a sentence, or
    ends the context if little is left; headers count only once they are in, so the budget can be exceeded by one."""
    def step(a: Column, c: Column) -> Column:
        left = most_chars - a["used"]
        over = F.length(c["text"]) > left
        stop = a["stop"] | (over & (left < min(30, most_chars * 0.15)))
        header = F.concat(F.lit("["), (a["n"] + 1).cast("string"), F.lit("] 《"), c["book"], F.lit("》"), c["chapter"], F.lit("："))
        body = F.concat(header, F.when(over, X.truncate_at_sentence(c["text"], left)).otherwise(c["text"]))
        kept = F.struct(F.array_append(a["parts"], body).alias("parts"), (a["used"] + F.length(body)).alias("used"), (a["n"] + 1).alias("n"), stop.alias("stop"))
        halted = F.struct(a["parts"].alias("parts"), a["used"].alias("used"), a["n"].alias("n"), stop.alias("stop"))
        return F.when(stop, halted).otherwise(kept)

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
    return F.array_join(F.aggregate(F.slice(items, 1, most_chunks), start, step)["parts"], "\n\n")


def references(hits: DataFrame, most: int = 3) -> DataFrame:
    """Distinct chunks among the first ``most`` hits of each query, in order."""
    first = hits.where(F.col("rank") <= most).groupBy("q", "id").agg(F.min("rank").alias("rank"), F.min_by("fused_score", "rank").alias("score"))
    return first.withColumn("ref_no", F.row_number().over(Window.partitionBy("q").orderBy("rank")).cast("long"))


def evidence(items: Column, most: int = 5) -> Column:
    """The evidence that a judge reads: numbered in the order given, with book and chapter less the marks and spaces at
    their ends, parted by blank lines; a fixed line where there is none. Null books, chapters and texts are empty."""
    own = lambda c, name: F.coalesce(c[name], F.lit(""))

    def line(c: Column, i: Column) -> Column:
        source = F.btrim(F.concat(F.lit("《"), own(c, "book"), F.lit("》"), own(c, "chapter")), F.lit("《》 "))
        number = F.concat(F.lit("[证据"), (i + 1).cast("string"), F.lit("]"))
        return F.concat(F.when(source == "", number).otherwise(F.concat(number, F.lit(" "), source)), F.lit("\n"), own(c, "text"))

    lines = F.array_join(F.transform(F.slice(items, 1, most), line), "\n\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit("（未检索到任何证据）"))
