"""What the stages of the pipeline hold in a Python worker."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import packing, quality, secrets, tiling
from ravelin.sources import scratch

DOCS = "doc_id long, text string"


def function_of(spark, monkeypatch, stage):
    """What a stage gives to ``mapInArrow``."""
    docs = spark.createDataFrame([], DOCS)
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, *_: run)
        return stage(docs)


def batch_of(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_stages_hand_over_few_rows_at_a_time(spark, monkeypatch):
    texts = [f"text {i} password=abcdefgh{i}" if i % 3 else None for i in range(1234)]
    bench = spark.createDataFrame([(1, "some other words of a benchmark")], "item_id long, text string")
    for stage in (lambda d: quality.accepted(d, None), secrets.redact, lambda d: tiling.without_contaminated(d, bench)):
        out = list(function_of(spark, monkeypatch, stage)(iter([batch_of(texts)])))
        assert max(b.num_rows for b in out) <= 500
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(1234))
    assert not list(function_of(spark, monkeypatch, secrets.redact)(iter([batch_of([])])))


def test_features_are_made_in_pieces():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(32, 400, n))) for n in rng.integers(0, 9000, 300)] + [None, "", "x" * 300_000]
    raw = [(t or "").encode() + b"\n" for t in texts]
    whole, counts = quality._encode(raw)
    chunks = list(quality.encode(iter(texts)))
    assert sum(len(n) for _, n in chunks) == len(texts)
    pieces, n = quality._pieces(raw)
    assert np.array_equal(pieces, whole) and np.array_equal(n, counts)
    tracemalloc.start()
    try:
        for _ in quality.encode(iter(texts)):
            pass
        assert tracemalloc.get_traced_memory()[1] < 50 << 20  # some 100 MB and more where a chunk is encoded at once
    finally:
        tracemalloc.stop()


def test_words_are_forgotten_when_a_task_ends(spark, monkeypatch):
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("word_bpe_49k.json")
    run = function_of(spark, monkeypatch, lambda d: packing.pack(d, path))
    monkeypatch.setattr(packing, "KEPT", 1)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    first = [b.to_pylist() for b in run(iter([batch_of(["Some words", None, "words again"])]))]
    assert first and [len(m) for m in packing.word_tokenizer(path).memory] == [1, 1]
    assert [b.to_pylist() for b in run(iter([batch_of(["Some words", None, "words again"])]))] == first
    assert all(packing.word_tokenizer(path)(["a word"])) and all(packing.word_tokenizer(path).memory)


def test_batch_rows_hold_for_one_write(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(scratch.BATCH)
    found = scratch.Scratch(spark, "test").write(spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long"), "sizes", 500)
    assert [r.n for r in found.collect()] == [500] * 4 and spark.conf.get(scratch.BATCH) == before
