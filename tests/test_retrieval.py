"""Retrieval, graphs, knowledge graphs and plans on small made-up data."""

import math

import pytest
from pyspark.sql import functions as F

from ravelin.operators import bm25, dense, fusion, graph, kg
from ravelin.plans import routing


def ranked(spark, rows):
    return spark.createDataFrame(rows, "q long, id string, score double, rank int")


def test_rrf_overlap_wins(spark):
    a = ranked(spark, [(1, "c1", 0.9, 1), (1, "c2", 0.8, 2), (1, "c3", 0.7, 3)])
    b = ranked(spark, [(1, "c2", 12.5, 1), (1, "c3", 10.0, 2), (1, "c4", 7.0, 3)])
    rows = fusion.fuse([("dense", 0.5, a), ("bm25", 0.3, b)]).orderBy("rank").collect()
    assert rows[0].id == "c2" and rows[0].sources == "dense,bm25" and rows[0].first_score == 0.8
    assert math.isclose(rows[0].fused_score, 0.5 / 62 + 0.3 / 61, abs_tol=1e-9)
    assert {r.id for r in rows} == {"c1", "c2", "c3", "c4"}


def test_rrf_ties_and_empty(spark):
    a, b = ranked(spark, [(1, "x", 1.0, 1)]), ranked(spark, [(1, "y", 1.0, 1)])
    assert [r.id for r in fusion.fuse([("dense", 0.5, a), ("bm25", 0.5, b)]).orderBy("rank").collect()] == ["x", "y"]
    assert fusion.fuse([("dense", 0.5, a.limit(0)), ("bm25", 0.5, b.limit(0))]).count() == 0


def test_bm25_ties_take_later_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "alpha alpha zz")], "item_id long, text string")
    rows = bm25.top_k(docs, asked).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1]
    idf = math.log((4 - 2 + 0.5) / 2.5 + 1)
    assert math.isclose(rows[0].score, round(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.0)), 6))


def test_dense_blocks_agree(spark):
    vectors = spark.range(50).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    asked = vectors.where("vec_id < 5")
    one = {tuple(r) for r in dense.top_k(vectors, asked, 3).collect()}
    assert one == {tuple(r) for r in dense.top_k(vectors, asked, 3, block=2).collect()} and len(one) == 15
    assert dense.top_k(vectors, asked.limit(0), 3).count() == 0


def entity_rows(spark):
    return spark.createDataFrame([("A", 1, ["c1", "c2"], ["Ay"]), ("B", 2, ["c2"], []), ("C", 3, [], [])], "name string, ord long, source_chunks array<string>, aliases array<string>")


def relation_rows(spark):
    rows = [("A", "likes", "B", ["c2"], 1), ("C", "likes", "A", ["c3"], 2), ("B", "sees", "D", ["c4"], 3)]
    return spark.createDataFrame(rows, "head string, relation string, tail string, source_chunks array<string>, ord long")


def test_graph(spark):
    edges = graph.edges(relation_rows(spark))
    assert {(r.source, r.target, r.direction) for r in edges.collect()} >= {("A", "B", "outgoing"), ("A", "C", "incoming")}
    seeds = spark.createDataFrame([(1, "A", 1.0, 1), (1, "nobody", 0.9, 2)], "q long, name string, score double, ord long")
    scores = {r.name: r.score for r in graph.expand_weighted(seeds, edges).collect()}
    assert scores == {"A": 1.0, "nobody": 0.9, "B": 0.5, "C": 0.5, "D": 0.25}
    assert {(r.name, r.hops) for r in graph.reachable(seeds, edges).collect()} == {("A", 0), ("nobody", 0), ("B", 1), ("C", 1), ("D", 2)}
    found = graph.related_chunks(graph.expand_weighted(seeds, edges), entity_rows(spark)).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [("c2", 1.5), ("c1", 1.0)] and found[0].matched_entities == 5
    bodies = spark.createDataFrame([("c1",)], "id string")
    assert [r.id for r in graph.related_chunks(graph.expand_weighted(seeds, edges), entity_rows(spark), bodies).collect()] == ["c1"]


def test_matching(spark):
    asked = spark.createDataFrame([(1, "about Ay and B"), (2, "")], "q long, text string")
    more = spark.createDataFrame([(1, "B", 0.9), (1, "C", 0.6), (1, "D", 0.5)], "q long, name string, score double")
    rows = graph.match_entities(asked, entity_rows(spark), more).orderBy("rank").collect()
    assert [(r.name, r.score, r.match) for r in rows] == [("A", 1.0, "exact"), ("B", 1.0, "exact"), ("C", 0.6, "vector")]


@pytest.mark.parametrize("most", [50_000, 9, 0])
def test_matching_moves_little_more_than_names(spark, monkeypatch, most):
    """Names of many lengths in long questions, by beginnings of any length: those that are there, and few rows for them."""
    monkeypatch.setattr(graph, "NAME_STARTS", most)
    names = ["x", "abc", "abcd", "abcde", "abca", "海", "海洋"] + [f"Name#{'0' * i}" for i in range(1, 30)]
    forms = [(n, i, [f"{n}~{i}"] if i % 3 == 0 else []) for i, n in enumerate(names)]
    texts = ["abcdeabc", "ab", "abca~4 x~0", "海洋", "Name#000 and " * 3, "", None, "no one of them " * 40 + "ab海", "x" * 50]
    entities = spark.createDataFrame(forms, "name string, ord long, aliases array<string>")
    asked = spark.createDataFrame(list(enumerate(texts)), "q long, text string")
    expected = set()
    for q, t in enumerate(texts):
        hits = sorted((0 if n in t else 1, o, n) for n, o, al in forms if n in t or any(a in t for a in al)) if t else []
        expected |= {(q, n, 0.9 if k else 1.0, r + 1) for r, (k, _, n) in enumerate(hits[:5])}
    rows = graph.match_entities(asked, entities)
    assert {(r.q, r.name, r.score, r["rank"]) for r in rows.collect()} == expected
    if most == 50_000:
        cut = [n for n in texts if n]
        moved = graph.name_cuts(asked, graph.name_forms(entities)).count()
        assert moved < sum(map(len, cut))  # one for each length that names have at each place before: some 30 times as many


def test_relation_search_threshold(spark):
    rows = spark.createDataFrame([(1, "A", "r", "B", 0.5), (1, "A", "r", "C", 0.49), (1, "A", "r", "D", 0.9)], "q long, head string, relation string, tail string, score double")
    assert [r.tail for r in graph.relation_search(rows).orderBy("rank").collect()] == ["D", "B"]


def test_kg_merges(spark):
    mentions = spark.createDataFrame([("嘉庚", "人物", "short", "c1", 1), ("陈嘉庚", "other", "longer text", "c2", 2), ("我们", "人物", "x", "c1", 3), ("厦大", "学校", "", "c3", 4)], "name string, type string, description string, chunk string, ord long")
    triples = spark.createDataFrame([("嘉庚", "人物", "founds", "厦门大学", "组织", "d", "c4", 1), ("嘉庚", "人物", "is", "陈嘉庚", "人物", "loop", "c4", 2), ("陈嘉庚", "人物", "founds", "厦大", "组织", "longer", "c5", 3)], "head string, head_type string, relation string, tail string, tail_type string, description string, chunk string, ord long")
    ents = {r.name: r for r in kg.entities(mentions, triples).collect()}
    assert set(ents) == {"陈嘉庚", "厦门大学"}
    assert ents["陈嘉庚"].type == "PERSON" and ents["陈嘉庚"].description == "longer text" and ents["陈嘉庚"].aliases == ["嘉庚"]
    assert ents["陈嘉庚"].source_chunks == ["c1", "c2", "c4", "c5"] and ents["厦门大学"].chunk_count == 3
    rels = kg.relations(triples).collect()
    assert [(r.head, r.relation, r.tail, r.description, r.chunk_count) for r in rels] == [("陈嘉庚", "founds", "厦门大学", "longer", 2)]
    s = kg.stats(kg.entities(mentions, triples), kg.relations(triples)).first()
    assert (s.total_entities, s.total_relations, s.alias_count, s.description_coverage) == (2, 1, 14, 0.5)


def test_extraction(spark):
    good = '```{"entities": [{"name": "A", "type": "person"}, {"name": "%s"}], "relations": [{"head": "A", "relation": "r", "tail": "B", "description": "x"}, {"head": "A", "relation": "r", "tail": "B", "description": "longer"}, {"head": "A", "relation": "r", "tail": "A"}]}```' % ("n" * 31)
    raw = spark.createDataFrame([("c1", good), ("c2", "talk"), ("c3", '{"entities": []}'), ("c4", '{"entities": [], "relations": []}')], "chunk_id string, raw string")
    rows = {r.chunk: r for r in kg.valid_extraction(raw).collect()}
    assert [rows[c].ok for c in ("c1", "c2", "c3", "c4")] == [True, False, False, True]
    assert [e.name for e in rows["c1"].entities] == ["A"]
    assert [(x.head, x.head_type, x.tail_type, x.description) for x in rows["c1"].triples] == [("A", "person", "OTHER", "longer")]


def test_plans(spark):
    asked = spark.createDataFrame([(1, "naive"), (2, "local"), (3, "global"), (4, "hybrid"), (5, None), (6, "?")], "q long, query_mode string")
    rows = {r.q: r for r in routing.call_counts(routing.with_plan(asked), F.lit(2).cast("long")).collect()}
    assert [rows[q].retrieval_calls for q in range(1, 7)] == [4, 4, 6, 8, 8, 8]
    assert not rows[1].use_evidence_judge and rows[5].use_relation


def test_judgement(spark):
    raw = spark.createDataFrame([("{}",), ("nothing",), ('{"sufficient": false, "missing": ["a", "", null], "reason": "r"}',)], "raw string")
    rows = [r.j for r in raw.select(routing.judgement(F.col("raw")).alias("j")).collect()]
    assert [r.sufficient for r in rows] == [True, True, False] and rows[2].missing == ["a"]


def test_retry(spark):
    asked = routing.with_plan(spark.createDataFrame([(1, "good", "hybrid"), (2, "bad", "hybrid"), (3, "same", "hybrid"), (4, "bad", "naive"), (5, "worse", "hybrid"), (6, "nothing", "local"), (7, "unsaid", "global"), (8, "nothing", "naive")], "q long, query string, query_mode string"))
    found = {"good": "h1", "better": "h2", "bad": "h3", "same": "h4", "worse": "h5", "unsaid": "h6"}
    names = F.create_map(*[F.lit(x) for p in found.items() for x in p])
    search = lambda qs: qs.select("q", names[F.col("query")].alias("id")).where("id IS NOT NULL").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rerank = lambda qs, hits: hits.where("copy = 2")
    judge = lambda qs, hits: hits.where("id <> 'h6'").select("q", F.col("id").isin("h1", "h2").alias("sufficient"), F.array(F.lit("point")).alias("missing"))
    rewrite = F.when((F.col("question") == "bad") & (F.col("missing")[0] == "point"), "better").when(F.col("question") == "same", "same")
    rewrite = rewrite.when(F.col("missing")[0] == routing.NO_EVIDENCE, "better").otherwise("")
    hits, outcome = routing.with_retry(asked, search, judge, rewrite, rerank=rerank)
    rows = {r.q: r for r in outcome.collect()}
    assert {q: (r.retry_count, r.sufficient) for q, r in rows.items()} == {1: (0, True), 2: (1, True), 3: (0, False), 4: (0, True), 5: (0, False), 6: (1, True), 7: (0, True), 8: (0, True)}
    assert {r.q: r.id for r in hits.collect()} == {1: "h1", 2: "h2", 3: "h4", 4: "h3", 5: "h5", 6: "h2", 7: "h6"} and hits.count() == 7
    assert rows[3].missing == ["point"] and rows[7].missing == [] and rows[8].missing == [routing.NO_EVIDENCE]


def test_evidence_numbers_what_is_given(spark):
    schema = "q long, contexts array<struct<rank long, id long, book string, chapter string, text string>>"
    rows = [(1, [(1, 7, "B", "one", "x"), (4, 8, None, "", None), (5, 9, "", " two ", "y")]), (2, [])]
    found = spark.createDataFrame(rows, schema).select("q", fusion.evidence(F.col("contexts")).alias("e"))
    assert {r.q: r.e for r in found.collect()} == {1: "[证据1] B》one\nx\n\n[证据2]\n\n\n[证据3] two\ny", 2: "（未检索到任何证据）"}


def test_bm25_cuts_each_text_once(spark):
    """Texts pass the tokeniser once for both the corpus' size and the postings; repeated and null rows count."""
    from ravelin.operators import bm25

    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        calls.add(1)
        return (text or "").split()

    seg = F.udf(counted, "array<string>")
    docs = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (2, "blue fox jumps"), (3, None), (4, "")], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(7, "red fox")], "item_id long, text string").coalesce(1)
    found = {r.id: r.score for r in bm25.top_k(docs, asked, segment=seg).collect()}
    n, avgdl = 5, 7 / 5
    part = lambda df, tf, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert found == {1: round(part(1, 2, 2) + part(2, 2, 2), 6), 2: round(part(2, 1, 3), 6)}
    assert calls.value <= 5 + 2  # every document, and the question for its terms and for its scores
