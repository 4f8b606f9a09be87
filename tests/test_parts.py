"""Smaller operators around retrieval, models, sessions and traces."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import backends
from ravelin.functions import text as X
from ravelin.operators import bm25, fusion, graph, memory, trace
from ravelin.plans import prompts, routing
from ravelin.sources import io
from ravelin.streaming import jobs


def test_route_scores(spark):
    one = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2)], "q long, id long, score double, rank int")
    two = spark.createDataFrame([(1, 6, 7.0, 1)], "q long, id long, score double, rank int")
    rows = {r.id: r for r in fusion.fuse([("dense", 0.5, one), ("bm25", 0.5, two)], keep_scores=True).collect()}
    assert rows[6].scores == {"dense": 0.8, "bm25": 7.0} and rows[5].scores == {"dense": 0.9}
    assert "scores" not in fusion.fuse([("dense", 0.5, one)]).columns


def test_segmenter(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "CDab"), (3, None)], "doc_id long, text string")
    pairs = lambda c: F.regexp_extract_all(c, F.lit(".."), F.lit(0))
    assert {(r.doc_id, r.term) for r in bm25.term_frequencies(docs, "doc_id", "text", segment=pairs).collect()} == {(1, "ab"), (1, "cd"), (2, "cd"), (2, "ab")}
    asked = spark.createDataFrame([(9, "xxcd")], "item_id long, text string")
    assert {r.id for r in bm25.top_k(docs, asked, 5, segment=pairs).collect()} == {1, 2} and bm25.top_k(docs, asked, 5).count() == 0


def test_graph_search(spark):
    entities = spark.createDataFrame([("A", 1, [], ["c1"]), ("B", 2, ["Bee"], ["c2"]), ("C", 3, [], ["c3"])], "name string, ord long, aliases array<string>, source_chunks array<string>")
    relations = spark.createDataFrame([("A", "r", "C", 1)], "head string, relation string, tail string, ord long")
    asked = spark.createDataFrame([(1, "what of A and Bee"), (2, "nobody")], "q long, text string")
    hits, expansion = graph.graph_search(asked, entities, graph.edges(relations), first=2)
    assert [(r.q, r.matched, r.expanded) for r in expansion.collect()] == [(1, ["A", "B"], ["A", "B"])]
    assert [r.id for r in hits.orderBy("rank").collect()] == ["c1", "c2"]
    assert graph.graph_search(asked, entities, graph.edges(relations))[1].first().expanded == ["A", "B", "C"]


def test_model_steps(spark):
    said = {"analyse": '{"query_mode": "local", "high_level_keywords": ["t"]}', "judge": 'so: {"sufficient": false, "missing": ["x"]}'}
    asked = spark.createDataFrame([(1, "who"), (2, "what")], "q long, query string")
    rows = routing.analysed(asked, lambda p: F.when(F.contains(p, F.lit("who")), said["analyse"]).otherwise("?")).orderBy("q").collect()
    assert [(r.query_mode, r.high_level_keywords, r.low_level_keywords) for r in rows] == [("local", ["t"], []), ("hybrid", [], [])]
    look = spark.createDataFrame([("q1", ["a", "b"]), ("q2", [])], "query string, k array<string>")
    assert [r.r for r in look.select(routing.relation_query(F.col("query"), F.col("k")).alias("r")).collect()] == ["a b", "q2"]
    contexts = spark.createDataFrame([(1, [(1, "id", "b", "c", "t1")])], "q long, contexts array<struct<rank: int, id: string, book: string, chapter: string, text: string>>")
    seen = routing.judged(contexts, asked.withColumnRenamed("query", "question"), lambda p: F.when(F.contains(p, F.lit("t1")), said["judge"])).collect()
    assert [(r.q, r.sufficient, r.missing) for r in seen] == [(1, False, ["x"])]
    state = spark.createDataFrame([("q", "cur", ["m1", "m2"])], "question string, current string, missing array<string>")
    assert state.select(routing.rewritten(lambda p: F.concat(F.lit(" "), F.regexp_extract(p, "- (m2)", 1))).alias("r")).first().r == "m2"
    for p in (prompts.answer(F.lit("Q"), F.lit("C")), prompts.extract(F.lit("T" * 900))):
        text = spark.range(1).select(p.alias("p")).first().p
        assert text.endswith("Q") or text.count("T") == 800 + prompts.EXTRACT.count("T") + 1


def test_one_rerank_call_for_a_query(spark):
    class Counting(backends.Deterministic):
        def rerank(self, query, texts):
            return [float(len(texts))] * len(texts)

    df = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), (None, None)], "q string, t string").coalesce(1)
    assert sorted(r.s for r in df.select(backends.rerank_score(F.col("q"), F.col("t"), Counting).alias("s")).collect()) == [1.0, 1.0, 2.0, 2.0]


def test_sessions(spark):
    sessions = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, created_at long")
    messages = spark.createDataFrame([("a", 7), ("a", 5)], "session_id string, created_at long")
    assert sorted((r.session_id, r.updated_at) for r in memory.touched(sessions, messages).collect()) == [("a", 7), ("b", 2)]
    rows = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 1, "z")], "conv_id long, turn long, text string")
    listed = memory.message_list(rows, spark.createDataFrame([(1,), (1,)], "conv_id long")).orderBy("place").collect()
    assert [(r.text, r.place) for r in listed] == [("y", 1), ("x", 2)]
    many = spark.range(50).select((F.col("id") % 10).alias("conv_id"), F.col("id").alias("turn"))
    places = memory.session_list(many).orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, 11)) and [r.conv_id for r in places] == list(range(9, -1, -1))


def test_traces(spark):
    rows = spark.createDataFrame([("q", "naive", {"search": 0.5, "judge": 0.1}, 0), ("q", "naive", {"search": 0.25}, 1)], "query string, query_mode string, latency map<string,double>, retry_count int")
    assert {(r.stage, r.seconds, r.rounds) for r in trace.latency_sums(rows).collect()} == {("search", 0.75, 2), ("judge", 0.1, 1)}
    assert [(r.queries, r.retried, r.rate) for r in trace.retry_rate(rows, F.col("retry_count")).collect()] == [(2, 1, 0.5)]


def test_extraction_stats(spark):
    rows = spark.createDataFrame([("a", True, ["x", "y"]), ("b", False, ["z"])], "chunk string, ok boolean, triples array<string>")
    assert jobs.extraction_stats(rows, {"success": 3, "failed": 1, "skipped": 0}, 2.0, left=10) == {"success": 3, "failed": 1, "skipped": 0, "triples": 2, "rate": 2.0, "eta": 5.0}


def test_vector_index_and_graph_rows(spark, tmp_path):
    path = str(tmp_path / "v")
    io.write_vectors(spark.createDataFrame([(1, [0.5, 0.5])], "id long, v array<double>"), path, "v", "m")
    rows, config = io.read_vectors(spark, path)
    assert rows.count() == 1 and config == {"count": 1, "dim": 2, "model": "m"}
    spark.range(2).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="rows instead"):
        io.read_vectors(spark, path)
    io.write_json_lines(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "chunk_id string, v int"), str(tmp_path / "g"))
    found = io.read_graph(spark, str(tmp_path / "g"), "chunk_id string, v int", "chunk_id", "v").collect()
    assert sorted((r.chunk_id, r.v) for r in found) == [("a", 3), ("b", 2)]
    assert spark.range(1).select(X.chunk_id(F.lit("b"), F.lit(1), F.lit(2)).alias("c")).first().c == "b_ch001_002"
