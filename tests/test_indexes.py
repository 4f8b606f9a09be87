"""Stored indexes, dictionary segmentation, paths and hubs against plain versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ravelin.functions import segment
from ravelin.operators import bm25, dense, graph, inverted_index, kg, spread, vector_index
from ravelin.sources.scratch import Scratch

# --- vectors ---------------------------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<float>, cell string").repartition(4)


@pytest.fixture(scope="module")
def clustered(spark):
    """Ten clusters; a third of all vectors are one and the same, so that ties go by id and one cell is full."""
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(10, 16))
    rows = [(i, centres[i % 10] + 0.1 * rnd.normal(size=16)) for i in range(800)] + [(1000 + i, centres[3]) for i in range(400)]
    return vectors_of(spark, [(i, v / np.linalg.norm(v)) for i, v in rows])


def plain_top(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted(((round(float(np.dot(np.float64(v), np.float64(x))), 6), i) for i, x in rows), key=lambda p: (-p[0], p[1]))
        out += [(q, i, s, r + 1) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_vector_index(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 16)
    index = vector_index.build_index(clustered, Scratch(spark, "t").path("index"), cells=10, model="m")
    assert (index.dim, index.count, index.cells, index.model) == (16, 1200, 10, "m")
    assert index.blocks.agg(F.max(F.size("ids"))).first()[0] <= 110  # the full cell has several blocks
    assert index.probes < 5  # clusters are found out
    rows = [(r.vec_id, r.embedding) for r in clustered.collect()]
    asked = clustered.where("vec_id % 50 = 0")
    expected = plain_top(rows, [r for r in rows if r[0] % 50 == 0], 20)
    got = [(r.q, r.id, round(r.score, 6), r["rank"]) for r in vector_index.search(index, asked, 20, exact=True).collect()]
    assert sorted(got) == sorted(expected)
    assert sorted((r.q, r.id, round(r.score, 6), r["rank"]) for r in vector_index.search(index, asked, 20, probes=10).collect()) == sorted(expected)
    truth = dense.top_k(clustered, asked, 20)
    found = vector_index.recall(vector_index.search(index, asked, 20), truth).agg(F.avg("recall"), F.count("*")).first()
    assert found[0] >= 0.9 and found[1] == asked.count()


def test_recall_without_clusters(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0")
    index = vector_index.build_index(vectors, Scratch(spark, "t").path("index"))
    assert vector_index.recall(vector_index.search(index, asked), dense.top_k(vectors, asked)).agg(F.avg("recall")).first()[0] >= 0.9


def test_odd_vector_indexes(spark):
    path = Scratch(spark, "t").path
    few = vectors_of(spark, [(1, [1, 0]), (2, [0, 1]), (None, [1, 1]), (3, None)])
    index = vector_index.build_index(few, path("few"), cells=1)
    assert index.count == 2
    assert sorted((r.q, r.id) for r in vector_index.search(index, few, 20, exact=True).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    nothing = vector_index.build_index(few.limit(0), path("nothing"))
    assert nothing.count == 0 and vector_index.search(nothing, few).count() == 0
    with pytest.raises(ValueError):
        vector_index.build_index(vectors_of(spark, [(1, [1]), (2, [1, 2])]), path("uneven"))
    spark.read.parquet(f"{path('few')}/blocks").limit(0).write.mode("overwrite").parquet(f"{path('broken')}/blocks")
    spark.read.parquet(f"{path('few')}/config").write.parquet(f"{path('broken')}/config")
    with pytest.raises(ValueError):
        vector_index.open_index(spark, path("broken"))


# --- postings --------------------------------------------------------------------------------------------------------


def test_inverted_index_is_bm25(spark):
    rnd = random.Random(6)
    words = [f"w{i:03d}" for i in range(200)]
    texts = [" ".join(rnd.choice(words[: rnd.choice((5, 40, 200))]) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", "w001 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(rnd.sample(words, 3))) for i in range(30)] + [(98, "nowhere"), (99, None)], "item_id long, text string")
    index = inverted_index.build_index(docs, Scratch(spark, "t").path("index"), block_docs=8)
    assert index.documents == 403 and index.postings.agg(F.max(F.size("docs"))).first()[0] <= 8
    hits, skipped = inverted_index.search(index, asked, 5)
    columns = ["q", "id", "score", "rank"]
    assert sorted(map(tuple, hits.select(columns).collect())) == sorted(map(tuple, bm25.top_k(docs, asked, 5).select(columns).collect()))
    looked = skipped.agg(F.sum("blocks").alias("all"), F.sum("looked_into").alias("some")).first()
    assert looked.some < 0.7 * looked.all  # most blocks were never opened
    again = inverted_index.open_index(spark, index.path)
    assert again == index and inverted_index.search(again, asked.limit(0))[0].count() == 0


def test_inverted_index_needs_unique_ids(spark):
    docs = spark.createDataFrame([(1, "alpha"), (1, "beta")], "doc_id long, text string")
    with pytest.raises(ValueError):
        inverted_index.build_index(docs, Scratch(spark, "t").path("index"))
    empty = inverted_index.build_index(docs.limit(0), Scratch(spark, "t").path("index"))
    assert inverted_index.search(empty, docs.withColumnRenamed("doc_id", "item_id"))[0].count() == 0


def test_inverted_index_cuts_each_text_once(spark, monkeypatch):
    cut = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        cut.add(len(texts))
        return texts.str.split(" ")

    rnd = random.Random(7)
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{rnd.randint(0, 30)}" for _ in range(rnd.choice((1, 9, 90))))) for i in range(300)], "doc_id string, text string").repartition(3)
    index = inverted_index.build_index(docs, Scratch(spark, "t").path("index"), segment=words, block_docs=8)
    assert cut.value == 300
    blocks = index.blocks.collect()
    assert sorted(i for b in blocks for i in b.ids) == sorted(f"d{i}" for i in range(300)) and max(len(b.ids) for b in blocks) == 8
    assert sum(b.dls[-1] == b.dls[0] for b in blocks) >= len(blocks) - 9  # of one length, but where one gives way to the next
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{i}") for i in range(30)], "item_id string, text string")
    plain = sorted(map(tuple, bm25.top_k(docs, asked, 5).select("q", "id", "score", "rank").collect()))
    for most in (1024, 7):
        monkeypatch.setattr(inverted_index, "DEAL_QUERIES", most)
        assert sorted(map(tuple, inverted_index.search(index, asked, 5)[0].select("q", "id", "score", "rank").collect())) == plain


# --- words -----------------------------------------------------------------------------------------------------------


def plain_segment(found, text):
    """The best of all ways to cut a text: weight, then the longer first words."""
    weights = {}
    for i in range(len(text)):
        for j, w in found.ends(text, i):
            weights[text[i:j]] = w
    best = None
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        words, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                words.append(text[start:i])
                start = i
        if all(w in weights or len(w) == 1 for w in words):
            value = (sum(weights.get(w, found.unknown) for w in words), [len(w) for w in words])
            best = max(best, (value, words)) if best else (value, words)
    return best[1]


def test_segmentation_is_the_best_of_all_cuts():
    rnd = random.Random(8)
    counts = {"".join(rnd.choice("甲乙丙") for _ in range(rnd.randint(1, 4))): rnd.randint(1, 30) for _ in range(25)}
    found = segment.Dictionary(counts)
    for _ in range(150):
        text = "".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randint(1, 10)))
        assert found.words(text) == plain_segment(found, text)


def test_segmentation_of_mixed_text():
    found = segment.Dictionary({"厦门": 20, "大学": 30, "厦门大学": 25, "创办": 10, "学生": 8})
    assert found.words("创办厦门大学 2024年abc12。大学生") == ["创办", "厦门大学", "2024", "年", "abc12", "。", "大学", "生"]
    found.add_whole("大学生")
    assert found.words("大学生") == ["大学生"] and found.words(" \n") == [] and found.words("") == []
    with pytest.raises(ValueError):
        segment.Dictionary({"two words": 1})


def test_bm25_over_a_dictionary(spark, tmp_path):
    (tmp_path / "words.txt").write_text("厦门大学 25 nt\n厦门 20\n\n大学 30\n创办 10\n嘉庚\n", encoding="utf-8")
    cut = segment.segmenter(segment.read_dictionary(spark, str(tmp_path / "words.txt")))
    docs = spark.createDataFrame([(1, "嘉庚创办厦门大学"), (2, "大学在厦门"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "厦门大学"), (2, "嘉庚")], "item_id long, text string")
    assert {(r.q, r.id) for r in bm25.top_k(docs, asked, segment=cut).collect()} == {(1, 1), (2, 1)}
    assert {(r.q, r.id) for r in inverted_index.search(inverted_index.build_index(docs, Scratch(spark, "t").path("i"), segment=cut), asked, segment=cut)[0].collect()} == {(1, 1), (2, 1)}


# --- paths and hubs --------------------------------------------------------------------------------------------------


def plain_paths(relations, centre, most):
    steps = [s for i, (a, b) in enumerate(relations) for s in ((a, b, i), (b, a, i))]
    one = [(t, [e]) for s, t, e in steps if s == centre]
    two = [(t, [*es, e]) for at, es in one for s, t, e in steps if s == at and e not in es]
    return [(t, es) for t, es in sorted(one + two, key=lambda p: (len(p[1]), p[1]))][:most]


@pytest.mark.parametrize("most", [3, 8, 1000])
def test_paths(spark, most):
    rnd = random.Random(9)
    relations = [tuple(rnd.sample("ABCDEFGH", 2)) for _ in range(25)] + [("A", "B"), ("B", "A"), ("Z", "A")]
    rels = spark.createDataFrame([(a, f"r{i}", b, i) for i, (a, b) in enumerate(relations)], "head string, relation string, tail string, ord long")
    found = graph.simple_paths(graph.edges(rels), spark.createDataFrame([("A",), ("Z",), ("nobody",)], "name string"), most)
    rows = found.orderBy("centre", "path_no").collect()
    for centre in "AZ":
        assert [(r.target, r.edges) for r in rows if r.centre == centre] == plain_paths(relations, centre, most)
        assert [r.path_no for r in rows if r.centre == centre] == list(range(1, len([r for r in rows if r.centre == centre]) + 1))
    nodes = graph.view_nodes(found, spark.createDataFrame([("A", "PERSON")], "name string, type string")).orderBy("place").collect()
    firsts = list(dict.fromkeys(["A", *(r.target for r in rows if r.centre == "A")]))
    assert [(r.name, r.type) for r in nodes if r.centre == "A"] == [(n, "PERSON" if n == "A" else "OTHER") for n in firsts]
    edges = graph.view_edges(found).where("centre = 'A'").orderBy("place").collect()
    assert [r.target for r in edges] == list(dict.fromkeys(r.target for r in rows if r.centre == "A"))


def test_hubs_are_dealt_out(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hub").otherwise(F.col("id").cast("string")).alias("k"), "id")
    dealt, hubs = spread.spread(rows, "k", ["id"], 500)
    assert [(r.k, r.parts) for r in hubs.collect()] == [("hub", 8)]
    sizes = [r["count"] for r in dealt.where("k = 'hub'").groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700 and dealt.count() == 5000
    left = spread.to_parts(spark.createDataFrame([("hub",), ("4500",), ("none",)], "k string"), "k", hubs, "k")
    assert left.join(dealt, ["k", "part"]).count() == 4001


def test_expansion_with_hubs_is_the_same(spark, monkeypatch):
    from ravelin.operators import graph as g

    rels = spark.range(600).select(F.when(F.col("id") < 400, "hub").otherwise(F.concat(F.lit("n"), (F.col("id") % 7).cast("string"))).alias("head"), F.lit("r").alias("relation"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("tail"), F.col("id").alias("ord")).where("head <> tail")
    seeds = spark.createDataFrame([(1, "hub", 1.0, 1), (1, "n3", 0.9, 2), (2, "n5", 1.0, 1)], "q long, name string, score double, ord long")
    one = sorted(map(tuple, g.expand_weighted(seeds, g.edges(rels)).collect()))
    monkeypatch.setattr(g, "spread", lambda rows, key, by: spread.spread(rows, key, by, 20))
    assert sorted(map(tuple, g.expand_weighted(seeds, g.edges(rels)).collect())) == one
    links = spark.range(300).select(F.lit("hub").alias("name"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk"))
    assert g.related_chunks(g.expand_weighted(seeds, g.edges(rels)), links, first=5, k=5).where("q = 1").count() == 5


def test_stored_graph_is_that_of_the_lists(spark):
    mentions = spark.createDataFrame([("嘉庚", "人物", "short", "c1", 1), ("陈嘉庚", "other", "longer text", "c2", 2), ("我们", "人物", "x", "c1", 3), ("厦大", "学校", "", None, 4)], "name string, type string, description string, chunk string, ord long")
    triples = spark.createDataFrame([("嘉庚", "人物", "founds", "厦门大学", "组织", "d", "c4", 1), ("嘉庚", "人物", "is", "陈嘉庚", "人物", "loop", "c4", 2), ("陈嘉庚", "人物", "founds", "厦大", "组织", "longer", "c5", 3)], "head string, head_type string, relation string, tail string, tail_type string, description string, chunk string, ord long")
    built = kg.build(mentions, triples, Scratch(spark, "t"))
    lists = kg.entities(mentions, triples)
    same = ["name", "type", "description", "chunk_count", "ord", "aliases"]
    assert sorted(map(repr, built.entities.select(same).collect())) == sorted(map(repr, lists.select(same).collect()))
    assert {tuple(r) for r in built.entity_links.collect()} == {(r.name, c) for r in lists.collect() for c in r.source_chunks}
    assert {tuple(r) for r in built.relation_links.collect()} == {(r.head, r.relation, r.tail, c) for r in kg.relations(triples).collect() for c in r.source_chunks}
    assert {tuple(r) for r in kg.relation_links(triples).collect()} == {tuple(r) for r in built.relation_links.collect()}
    assert math.isclose(kg.stats(built.entities, built.relations).first().description_coverage, 0.5)


def test_names_of_a_graph_are_those_of_the_stored_graph(spark, monkeypatch):
    mentions = spark.createDataFrame([("嘉庚", "人物", "short", "c1", 1), ("陈嘉庚", "other", "longer text", "c2", 2), ("我们", "人物", "x", "c1", 3), ("厦大", "学校", "", None, 4)], "name string, type string, description string, chunk string, ord long")
    triples = spark.createDataFrame([("嘉庚", "人物", "founds", "厦门大学", "组织", "d", "c4", 1), ("嘉庚", "人物", "is", "陈嘉庚", "人物", "loop", "c4", 2), ("陈嘉庚先生", "人物", "founds", "厦大", "组织", "longer", "c5", 3), ("12", "人物", "founds", "厦大", "组织", "noise", "c6", 4)], "head string, head_type string, relation string, tail string, tail_type string, description string, chunk string, ord long")
    stored = kg.build(mentions, triples, Scratch(spark, "t"))
    for most in (100, 0):
        monkeypatch.setattr(kg, "CHANGED_NAMES", most)
        built = kg.build_names(mentions, triples, Scratch(spark, "t"))
        for table, same in (("entities", ["name", "type", "description", "ord", "aliases"]), ("relations", ["head", "relation", "tail", "ord"])):
            assert sorted(map(repr, getattr(built, table).select(same).collect())) == sorted(map(repr, getattr(stored, table).select(same).collect()))
        for table in ("entity_links", "relation_links"):
            assert {tuple(r) for r in getattr(built, table).collect()} == {tuple(r) for r in getattr(stored, table).collect()}


def test_chunk_sums_of_many_queries_and_repeated_links(spark, monkeypatch):
    from ravelin.operators import graph as g

    scored = [(q, f"n{i}", (i * 7 + q) % 5 / 4, i) for q in range(70) for i in range(12) if (i + q) % 3]
    links = [(f"n{i}", c) for i in range(12) for c in ("all", f"c{i % 4}", f"c{i % 5}", f"c{i % 4}")]
    sums = {}
    for q, n, s, o in scored:
        for c in {c for m, c in links if m == n}:
            old = sums.get((q, c), (0.0, 99))
            sums[q, c] = (old[0] + s, min(old[1], o))
    expected = {(q, i + 1, c, round(s, 6)) for q in range(70) for i, (s, o, c) in enumerate(sorted(((s, o, c) for (p, c), (s, o) in sums.items() if p == q), key=lambda x: (-x[0], x[1], x[2]))[:3])}
    rows = spark.createDataFrame(scored, "q long, name string, score double, ord long")
    table = spark.createDataFrame(links, "name string, chunk string")
    for part_rows in (50_000, 5):
        monkeypatch.setattr(g, "spread", lambda r, key, by: spread.spread(r, key, by, part_rows))
        monkeypatch.setattr(g, "hubs_of", lambda r, key: spread.hubs_of(r, key, part_rows))
        assert {(r.q, r["rank"], r.id, r.score) for r in g.related_chunks(rows, table, first=4, k=3).collect()} == expected


@pytest.mark.parametrize("few, tried, depth", [(500_000, 64, 2), (0, 1, 2), (500_000, 2, 1), (500_000, 3, 3)])
def test_recall_scores_few_chunks_and_gives_what_all_give(spark, monkeypatch, few, tried, depth):
    """Scores of unequal seeds, places that tie, repeated edges and links, chunks of too many names for a bound."""
    rng = random.Random(depth + tried)
    names = [f"n{i}" for i in range(60)]
    ends = [(rng.choice(names), "r", rng.choice(names), rng.randrange(80)) for _ in range(90)]
    rels = spark.createDataFrame([e for e in ends if e[0] != e[2]] * 2, "head string, relation string, tail string, ord long")
    linked = [(rng.choice(names), c) for c in range(3000) for _ in range(1 if c % 40 else 9)] + [(n, 7) for n in names] + [(n, 11) for n in names[:30]] + [(None, 3), ("n1", None)]
    links = spark.createDataFrame(linked + linked[:200], "name string, chunk long")
    seeds = [(q, n, rng.choice([1.0, 0.9, 0.95, 0.6]), o) for q in range(12) for o, n in enumerate(rng.sample(names, rng.choice([1, 2, 4])), 1)]
    seeds = spark.createDataFrame(seeds + [(40, "nowhere", 1.0, 1)], "q long, name string, score double, ord long")
    monkeypatch.setattr(graph, "FRONT_NAMES", few)
    monkeypatch.setattr(graph, "TRIED", tried)
    monkeypatch.setattr(graph, "spread", lambda rows, key, by: spread.spread(rows, key, by, 20))
    rows = lambda df: sorted(map(tuple, df.select("q", "id", "score", "rank").collect()))
    scratch, steps = Scratch(spark, "t"), graph.edges(rels)
    assert rows(graph.recall_chunks(seeds, steps, links, None, depth, first=6, k=5, scratch=scratch)) == rows(graph.related_chunks(graph.expand_weighted(seeds, steps, depth), links, first=6, k=5))
    if tried > 3:
        assert spark.read.parquet(scratch.path("ids-left")).count() < 1500


def test_steps_of_a_graph_are_those_of_the_stored_graph(spark, monkeypatch):
    mentions = spark.createDataFrame([("嘉庚", "人物", "short", "c1", 1), ("陈嘉庚", "other", "longer text", "c2", 2), ("我们", "人物", "x", "c1", 3), ("厦大", "学校", "", None, 4)], "name string, type string, description string, chunk string, ord long")
    triples = spark.createDataFrame([("嘉庚", "人物", "founds", "厦门大学", "组织", "d", "c4", 1), ("嘉庚", "人物", "is", "陈嘉庚", "人物", "loop", "c4", 2), ("陈嘉庚先生", "人物", "founds", "厦大", "组织", "longer", "c5", 3), ("12", "人物", "founds", "厦大", "组织", "noise", "", 4)], "head string, head_type string, relation string, tail string, tail_type string, description string, chunk string, ord long")
    stored = kg.build(mentions, triples, Scratch(spark, "t"))
    rows = lambda df: sorted(set(map(repr, df.collect())))
    for most in (100, 0):
        monkeypatch.setattr(kg, "CHANGED_NAMES", most)
        built = kg.build_steps(mentions, triples, Scratch(spark, "t"))
        assert rows(built.entities.select("name", "ord", "aliases")) == rows(stored.entities.select("name", "ord", "aliases"))
        assert rows(built.relations.groupBy(kg.TRIPLE).agg(F.min("ord").alias("ord"))) == rows(stored.relations.select(*kg.TRIPLE, "ord"))
        assert rows(built.entity_links) == rows(stored.entity_links) and rows(built.relation_links) == rows(stored.relation_links)
    numbers = kg.build_steps(mentions, triples, Scratch(spark, "t"), F.regexp_extract("chunk", "([0-9]+)$", 1).try_cast("long"))
    assert {r.chunk for r in numbers.entity_links.collect()} == {1, 2, 4, 5} and {r.chunk for r in numbers.relation_links.collect()} == {4, 5}


@pytest.mark.parametrize("most", [500_000, 0])
def test_only_words_that_are_asked_for_are_moved(spark, monkeypatch, most):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "beta alpha"), (2, "gamma gamma"), (3, "nothing")], "item_id long, text string")
    seen, write = {}, Scratch.write

    def kept(self, df, name, *more):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name, *more)

    monkeypatch.setattr(Scratch, "write", kept)
    monkeypatch.setattr(bm25, "ASKED_TERMS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where nothing is known of the sizes
    try:
        found = {(r.q, r.id) for r in bm25.top_k(docs, asked).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {(1, 1), (1, 2), (2, 2)}
    assert ("SortMergeJoin" not in seen["terms"]) == (most > 0)
