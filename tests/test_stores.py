"""Stores that change, extraction that takes up where it was killed, and the merging sink."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from ravelin.sources import merge_sink
from ravelin.sources.session_store import BUCKETS, SessionStore
from ravelin.streaming.extraction import BreakerOpen, ExtractionStore, extract_stream

AT = datetime.datetime(2024, 1, 1)


def talk(spark, sessions, turns, first=0, role="user"):
    rows = [(s, t, role if t % 2 == 0 else "assistant", f"text {t} of {s}", AT + datetime.timedelta(minutes=t)) for s in sessions for t in range(first, turns)]
    return spark.createDataFrame(rows, "session_id string, turn long, role string, text string, created_at timestamp")


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_session_store(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "s"))
    assert store.table("messages").count() == 0
    names = [f"s{i}" for i in range(30)]
    store.add_messages(talk(spark, names, 8))
    assert store.table("messages").count() == 240 and store.table("sessions").count() == 30
    one = store.table("sessions").where("session_id = 's3'").first()
    assert one.title == "text 0 of s3..." and one.updated_at == AT + datetime.timedelta(minutes=7) and one.cursor is None
    # A change of one session leaves the files of all other buckets alone, and made again it changes nothing.
    before = stamps(str(tmp_path / "s"))
    store.add_messages(talk(spark, ["s3"], 10, 8))
    own = spark.range(1).select(F.pmod(F.xxhash64(F.lit("s3")), F.lit(BUCKETS)).alias("b")).first().b
    after = stamps(str(tmp_path / "s"))
    assert {p for p in before if f"bucket={own}/" not in p} == {p for p in after if f"bucket={own}/" not in p}
    assert all(after[p] == t for p, t in before.items() if f"bucket={own}/" not in p)
    rows = lambda: sorted(map(tuple, store.table("messages").collect()))
    once = rows()
    store.add_messages(talk(spark, ["s3"], 10, 8))
    assert rows() == once and len(once) == 242
    # Titles stay, summaries move on and never back.
    assert store.table("sessions").where("session_id = 's3'").first().title == "text 0 of s3..."
    assert sorted(r.turn for r in store.pending().where("session_id = 's3'").collect()) == [0, 1, 2, 3]
    summary = lambda text, cursor: spark.createDataFrame([("s3", text, cursor)], "session_id string, summary string, cursor long")
    store.set_summaries(summary("sum", 3))
    store.set_summaries(summary("older", 1))
    one = store.table("sessions").where("session_id = 's3'").first()
    assert (one.summary, one.cursor) == ("sum", 3) and store.pending().where("session_id = 's3'").count() == 0
    # Deleting the only sessions of a bucket leaves no rows behind.
    store.delete(spark.createDataFrame([(n,) for n in [*names, "nobody"]], "session_id string"))
    assert store.table("messages").count() == 0 and store.table("sessions").count() == 0
    store.delete(spark.createDataFrame([], "session_id string"))


def chunk_files(spark, path, names):
    for k, part in enumerate(names):
        spark.createDataFrame([(c, "text") for c in part], "chunk_id string, text string").coalesce(1).write.mode("append").json(path)


def stream(spark, path):
    return spark.readStream.schema("chunk_id string, text string").option("maxFilesPerTrigger", 1).json(path)


good = lambda df: df.select("chunk_id", F.concat(F.lit("x"), "chunk_id").alias("raw"))


def test_extraction_is_killed_and_goes_on(spark, tmp_path):
    path, store = str(tmp_path / "chunks"), ExtractionStore(spark, str(tmp_path / "out"))
    chunk_files(spark, path, [[f"c{k}{i}" for i in range(5)] for k in range(4)] + [["c00", "c31", "new"]])
    calls = []

    def killed(df):
        calls.append(1)
        if len(calls) == 3:  # in the middle of the third batch, after its results were written
            store_path = f"{store.path}/results/batch=2"
            good(df).write.mode("overwrite").parquet(store_path)
            raise RuntimeError("killed")
        return good(df)

    with pytest.raises(Exception, match="killed"):
        extract_stream(stream(spark, path), store, killed, str(tmp_path / "c"))
    extract_stream(stream(spark, path), store, good, str(tmp_path / "c"))
    rows = [r.chunk_id for r in store.results().collect()]
    assert len(rows) == len(set(rows)) == 21  # none twice, none lost
    assert store.open_chunks(spark.read.schema("chunk_id string, text string").json(path)).count() == 0
    ledger = {r.batch: (r.success, r.failed) for r in store.ledger().collect()}
    assert len(ledger) == 5 and sum(s for s, _ in ledger.values()) == 21
    assert store.progress(21)["success"] == 21 and store.progress(21)["eta"] == 0.0


def test_breaker_outlives_a_run(spark, tmp_path):
    path, store = str(tmp_path / "chunks"), ExtractionStore(spark, str(tmp_path / "out"), most_failures=8)
    chunk_files(spark, path, [[f"c{k}{i}" for i in range(5)] for k in range(4)])
    bad = lambda df: df.select("chunk_id", F.lit(None).cast("string").alias("raw"))
    with pytest.raises(Exception, match="failed in a row"):
        extract_stream(stream(spark, path), store, bad, str(tmp_path / "c"))
    assert store.failures() == 10 and store.ledger().count() == 2
    with pytest.raises(Exception, match="failed in a row"):
        extract_stream(stream(spark, path), store, good, str(tmp_path / "c"))
    store.reset_breaker()
    extract_stream(stream(spark, path), store, good, str(tmp_path / "c"))
    chunks = spark.read.schema("chunk_id string, text string").json(path)
    assert store.open_chunks(chunks).count() == 10  # what failed stays open, until a later batch takes it
    store.extract(store.open_chunks(chunks), store.next_batch(), good)
    assert store.open_chunks(chunks).count() == 0 and store.failures() == 0
    with pytest.raises(BreakerOpen):
        ExtractionStore(spark, str(tmp_path / "out"), most_failures=0).extract(chunks, 99, good)


CLIENT = "ravelin.sources.merge_sink:SqliteClient"


def test_merge_sink(spark, tmp_path):
    path = str(tmp_path / "graph.db")
    nodes = spark.range(1300).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("PERSON").alias("type"), "id").repartition(3)
    assert merge_sink.merge_into(nodes, "Entity", ["name"], CLIENT, overwrite=True, path=path) == 1300
    # The same rows again, some changed: the target is the same but for these.
    changed = nodes.withColumn("type", F.when(F.col("id") < 10, "ORG").otherwise(F.col("type")))
    assert merge_sink.merge_into(changed, "Entity", ["name"], CLIENT, path=path) == 1300
    client = merge_sink.SqliteClient({"path": path})
    assert sorted(client.rows("Entity")) == sorted(map(tuple, changed.collect()))
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("a", "s", "b")], "head string, relation string, tail string")
    assert merge_sink.merge_into(edges, "RELATED", ["head", "relation", "tail"], CLIENT, path=path) == 2
    with pytest.raises(ValueError):
        merge_sink.merge_into(edges.withColumn("head", F.lit(None).cast("string")), "RELATED", ["head"], CLIENT, path=path)


def test_a_task_that_runs_twice_leaves_the_same(tmp_path):
    options = {"client": CLIENT, "kind": "k", "key": "a", "batch": "2", "path": str(tmp_path / "x.db")}
    writer = merge_sink.MergeWriter(options, ["a", "b"], True)
    rows = [(i, f"v{i}") for i in range(5)]
    with pytest.raises(ZeroDivisionError):
        writer.write(r if r[0] < 3 else 1 / 0 for r in rows)
    assert (writer.write(iter(rows)), writer.write(iter(rows))) == (merge_sink.Written(5, 3), merge_sink.Written(5, 3))
    writer.commit([merge_sink.Written(5, 3)])
    writer.abort([None])
    assert sorted(merge_sink.SqliteClient(options).rows("k")) == rows
    with pytest.raises(ValueError):
        merge_sink.MergeWriter(options | {"key": "z"}, ["a"], False)
