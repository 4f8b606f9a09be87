"""Sessions, sources, backends and streams."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import backends
from ravelin.operators import memory
from ravelin.sources import io
from ravelin.streaming import jobs


def messages(spark, n):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("n,pending", [(6, []), (7, [1]), (8, [1, 2]), (10, [1, 2, 3, 4])])
def test_windows(spark, n, pending):
    rows = messages(spark, n)
    assert sorted(r.turn for r in memory.pending_summary(rows).collect()) == pending
    assert memory.recent_window(rows).count() == 6
    cursor = spark.createDataFrame([(1, 2)], "conv_id long, cursor long")
    assert sorted(r.turn for r in memory.pending_summary(rows, cursor).collect()) == [p for p in pending if p > 2]


def test_history_and_summary(spark):
    rows = messages(spark, 8)
    old = spark.createDataFrame([(1, "before", -1)], "conv_id long, summary string, cursor long")
    history = memory.chat_history(rows, old).orderBy("place").collect()
    assert [r.text for r in history] == ["before", "m3", "m4", "m5", "m6", "m7", "m8"] and history[0].role == "system"
    new = memory.summarise(memory.pending_summary(rows), old, lambda p: p).first()
    assert new.cursor == 2 and "m1" in new.summary and "before" in new.summary
    kept = memory.summarise(memory.pending_summary(rows), old, lambda p: F.lit(" ")).first()
    assert (kept.summary, kept.cursor) == ("before", -1)
    assert memory.session_titles(rows).first().title == "m1..."
    assert memory.delete_session(rows, rows.limit(1)).count() == 0


def test_sources(spark, tmp_path):
    path = str(tmp_path / "x")
    io.write_json_lines(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int"), path)
    (tmp_path / "x" / "part-bad.json").write_text("{broken\n")
    assert io.read_json_lines(spark, path, "chunk_id string, v int", lenient=True).where("chunk_id IS NOT NULL").count() == 2
    assert io.read_json_lines(spark, str(tmp_path / "none"), "chunk_id string", optional=True).count() == 0
    assert {r.chunk_id for r in io.processed_ids(spark, path).collect()} == {"a", "b"}
    (tmp_path / "book.txt").write_text("line", encoding="utf-8")
    assert [tuple(r) for r in io.read_books(spark, str(tmp_path)).collect()] == [("book", "line")]
    (tmp_path / "words").write_text("the\n\n of \n")
    assert io.read_lexicon(spark, str(tmp_path / "words"), ["a"]) == ["a", "of", "the"]
    (tmp_path / ".env").write_text("# c\nA=1\nB='x=y'\nA=2\n")
    assert io.read_settings(str(tmp_path / ".env")) == {"A": "1", "B": "x=y"}
    assert io.append_traces(spark.range(1), None) is None


def test_vector_collection(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("text")).repartition(5)
    rows = io.vector_collection(df, ["id"], "chunk", None, "text").collect()
    assert sorted((r.pk, r.id, r.ext_id) for r in rows) == [(i, i, f"chunk_{i}") for i in range(100)]


def test_backends(spark):
    df = spark.createDataFrame([("a b",), (" ",), (None,)], "text string")
    assert [r.o for r in df.select(backends.rewrite(F.col("text"), None, backends.Deterministic).alias("o")).collect()] == ["a b", "", None]
    assert len(df.select(backends.embed(F.col("text"), backends.Deterministic).alias("v")).first().v) == 64

    def broken(_):
        raise OSError

    model = backends.Rotating([broken, lambda p: "ok"], lambda p: "local")
    assert model.chat("x") == "ok"
    model = backends.Rotating([broken], lambda p: "local")
    assert model.chat("x") == "local" and model.local
    assert backends.Rotating([broken]).chat("x") == ""


def test_streams(spark, tmp_path):
    messages(spark, 10).write.parquet(str(tmp_path / "m"))
    source = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "m"))
    out = jobs.rolling_summaries(source, lambda old, lines: f"{old}|{len(lines)}")
    rows = jobs.run_to_memory(out, "summaries", str(tmp_path / "c1")).collect()
    assert [(r.conv_id, r.summary, r.cursor) for r in rows] == [(1, "|4", 4)]


def test_waves(spark):
    chunks = spark.range(40).select(F.format_string("c%02d", "id").alias("chunk_id"), F.lit("text").alias("text"))
    written = []
    none = spark.createDataFrame([], "chunk_id string")
    out = jobs.extract_in_waves(chunks, none, lambda p: p.select("chunk_id", F.lit(None).cast("string").alias("raw")), written.append, most_failures=5)
    assert out["success"] == 0 and out["failed"] >= 5 and out["failed"] + out["skipped"] == 40 and not written
    out = jobs.extract_in_waves(chunks, none, lambda p: p.select("chunk_id", F.lit("x").alias("raw")), lambda df: written.append(df.count()))
    assert out == {"success": 40, "failed": 0, "skipped": 0} and sum(written) == 40
    with pytest.raises(ValueError):
        jobs.extract_in_waves(chunks, none, lambda p: p, written.append, most_failures=0)
