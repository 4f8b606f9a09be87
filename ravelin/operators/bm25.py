"""BM25 over an inverted index that is expressed as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as X
from ravelin.sources.scratch import Scratch

K1, B = 1.5, 0.75
#: Terms of queries, one for each query that has it, that go to every task up to so many: the words of texts stay where they are cut.
ASKED_TERMS = 500_000


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col), F.explode(X.tokens(F.col(text_col), stop_words, segment)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, dl): tokens of each document, 0 included; no shuffle."""
    return docs.select(id_col, F.coalesce(F.size(X.tokens(F.col(text_col), stop_words, segment)), F.lit(0)).cast("long").alias("dl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def term_weights(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, df, idf) of every term."""
    tf = term_frequencies(docs, id_col, text_col, stop_words, segment)
    return tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", stop_words: list[str] | None = None, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query, id, score) for every query and document with a term in common.

    Texts are cut once: only the terms of some query leave a task, as (id, length, term, frequency) rows, and a row for
    each document, of which the size of the corpus is counted. These are written once; up to ``ASKED_TERMS`` terms go to
    every task, so that no other word is moved. Where many searches are made over one corpus, ``inverted_index`` stores what is cut here each time. A
    query's repeated terms count as often as they stand there.
    """
    scratch = Scratch(docs.sparkSession, "bm25-scores")
    wanted = queries.select(F.col(query_col).alias("q"), F.explode(X.tokens(F.col(query_text_col), stop_words, segment)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    cut = docs.select(F.col(id_col).alias("id"), F.coalesce(X.tokens(F.col(text_col), stop_words, segment), F.array().cast("array<string>")).alias("ws"))
    # A row without a term stands for the document itself.
    rows = cut.select("id", F.size("ws").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "ws")).alias("term"))
    wanted = scratch.write(wanted, "wanted")
    asked = wanted.select("term", F.lit(True).alias("asked")).distinct()
    if few := wanted.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS:
        kept = rows.join(F.broadcast(asked), "term", "left")
    else:  # the key of a document's own row is none that a term can have, and not one for all
        rows = rows.withColumn("key", F.coalesce("term", F.concat(F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit("")))))
        kept = rows.join(asked.withColumnRenamed("term", "key"), "key", "left")
    kept = kept.where("asked OR term IS NULL")
    stored = scratch.write(kept.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")), "terms")
    n = F.coalesce(F.sum("tf"), F.lit(0))
    corpus = stored.where("term IS NULL").agg(n.alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.greatest(n, F.lit(1))).alias("avgdl"))
    tf = stored.where("term IS NOT NULL")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    sent = F.broadcast if few else lambda rows: rows
    joined = tf.join(sent(df), "term").join(sent(wanted), "term").crossJoin(F.broadcast(corpus))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("q", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 20, **columns) -> DataFrame:
    """(q, id, score, rank); of equal scores, the later document first."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("id"))
    return scores(docs, queries, **columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
