"""The smaller pieces: defaults, keywords, answers, caches, schemas, exports, registration."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import text as X
from ravelin.operators import trace
from ravelin.plans import routing
from ravelin.sources import io


def test_analysis_defaults_and_keywords(spark):
    df = spark.createDataFrame([(1, "q", None, None, ["a", "b"], None), (2, "r", "naive", ["x"], [], "why")], "q int, query string, query_mode string, low_level_keywords array<string>, high_level_keywords array<string>, reason string")
    rows = routing.with_analysis_defaults(df).withColumn("kw", X.keywords_or(F.col("query"), F.col("high_level_keywords"))).orderBy("q").collect()
    assert [(r.query_mode, r.low_level_keywords, r.reason, r.kw) for r in rows] == [("hybrid", [], "", "a b"), ("naive", ["x"], "why", "r")]
    out = spark.createDataFrame([(["a", "", None, "b"],), ([],)], "p array<string>").select(X.bullet_list(F.col("p"), "none").alias("o")).collect()
    assert [r.o for r in out] == ["- a\n- b", "none"]


def test_blank_questions_fail(spark):
    good = spark.createDataFrame([("ok",)], "query string")
    assert routing.checked(good).first().query == "ok"
    with pytest.raises(Exception, match="blank"):
        routing.checked(spark.createDataFrame([(" ",)], "query string")).collect()


def test_answers(spark):
    outcome = spark.createDataFrame([(1, "what", True), (2, "who", False), (3, "none", False)], "q int, question string, sufficient boolean")
    contexts = spark.createDataFrame([(1, [("b", "c", "text")]), (2, [("b", "c", "text")] * 4)], "q int, contexts array<struct<book: string, chapter: string, text: string>>")
    rows = {r.q: r for r in routing.answers(outcome, contexts, lambda p: p, "CAUTION", "sorry").collect()}
    assert rows[1].answer.endswith("what") and "CAUTION" not in rows[1].answer
    assert rows[2].answer.endswith("CAUTION") and rows[2].context_used == 3
    assert (rows[3].answer, rows[3].context_used) == ("sorry", 0)


def test_cache_has_the_history_in_its_key(spark):
    asked = spark.createDataFrame([("q", 1), ("q", 2)], "question string, history_hash int")
    assert [r.history_hash for r in routing.uncached(asked, asked.limit(1)).collect()] == [2]


def test_schemas_vectors_and_counts(spark, tmp_path):
    old, new = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert sorted((r.a, r.b) for r in io.merge_schema(old, new).collect()) == [(1, None), (2, "x")]
    vectors = spark.createDataFrame([(1, [0.0, 1.0])], "id int, v array<double>")
    io.write_vectors(vectors, str(tmp_path / "v"), "v", "model")
    assert tuple(spark.read.parquet(str(tmp_path / "v/config")).select("count", "dim", "model").first()) == (1, 2, "model")
    io.verify_counts(spark, {str(tmp_path / "v/rows"): 1})
    with pytest.raises(ValueError):
        io.verify_counts(spark, {str(tmp_path / "v/rows"): 2})


def test_trace_rows_and_registration(spark):
    row = spark.range(1).select(trace.trace_row(F.lit("q"), F.lit("naive"), F.create_map(F.lit("rerank"), F.lit(0.123456)), retry_count=F.lit(1)).alias("t")).first().t
    assert row.latency == {"rerank": 0.1235} and row.retry_count == 1 and len(row.timestamp) == 19
    X.register(spark)
    assert spark.sql("SELECT ravelin_sentences('甲。乙') AS s").first().s == ["甲。", "乙"]
