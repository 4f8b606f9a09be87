"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._slices import ROWS, slices

PASSAGE_BYTES = 512
CHUNK_BYTES = 2 << 20
PIECE_BYTES = 128 << 10
SAMPLE_ROWS = 3000  # labelled documents that the classifier is fitted to, half of each label at most
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#*$%&<>", "\"'()[]{}", "-_/\\=+@^~`")
N_CLASSES = len(_GROUPS) + 3
N_FEATURES = N_CLASSES * N_CLASSES + 2
_CLASS = np.array([next((i for i, g in enumerate(_GROUPS) if chr(b) in g), len(_GROUPS) + (0 if b < 128 else 1 if b < 192 else 2)) for b in range(256)], np.uint8)


def encode(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of the passages, passages of each document) for texts in turn, a few MB of them at a time.

    A passage is ``PASSAGE_BYTES`` bytes of the text, the last one shorter. Its features: how often a byte of one
    class follows one of another, by the square root of their share, how far it deflates, and its share of a passage.
    """
    part, size = [], 0
    for text in texts:
        part.append((text or "").encode() + b"\n")
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield _pieces(part)
            part, size = [], 0
    if part:
        yield _pieces(part)


def _pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_encode``, about ``PIECE_BYTES`` at a time: it needs some hundred bytes for each byte of text."""
    cuts = np.flatnonzero(np.diff(np.cumsum([len(r) for r in raw]) // PIECE_BYTES)) + 1
    features, counts = zip(*(_encode(raw[lo:hi], raw[hi][:1] if hi < len(raw) else b"") for lo, hi in zip([0, *cuts], [*cuts, len(raw)])))
    return np.vstack(features), np.concatenate(counts)


def _encode(raw: list[bytes], follows: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in raw])
    counts = -(-lengths // PASSAGE_BYTES)
    first = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = first + within // PASSAGE_BYTES
    kind = _CLASS[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    after = np.append(kind[1:], _CLASS[follows[0]] if follows else kind[-1])
    pairs = np.bincount(passage * (N_CLASSES * N_CLASSES) + kind * N_CLASSES + after, minlength=counts.sum() * N_CLASSES * N_CLASSES)
    sizes = np.bincount(passage, minlength=counts.sum())
    pairs = np.sqrt(pairs.reshape(-1, N_CLASSES * N_CLASSES) / sizes[:, None])
    deflated = [len(zlib.compress(r[a : a + PASSAGE_BYTES], 1)) for r in raw for a in range(0, len(r), PASSAGE_BYTES)]
    more = np.column_stack([np.array(deflated) / (sizes + 24), sizes / PASSAGE_BYTES])
    return np.hstack([pairs, more]).astype(np.float32), counts


@dataclass
class Classifier:
    """Passages x become h = tanh(W x + b); a document is the sum of h weighted by softmax(w . tanh(V h) * sigmoid(U h))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.weights, (features - self.mean) / self.scale, counts)[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    a = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return h, t, g, a, z, z @ p["c"] + p["d"]


def train(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 150, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Classifier:
    """Fit to document labels by full gradients (Adam); labels weigh alike, whatever their share."""
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x, starts, random = (features - mean) / scale, np.cumsum(counts) - counts, np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,)}
    p = {k: (random.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()} | {"b": np.zeros(hidden, np.float32), "d": np.zeros(1, np.float32)}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    for step in range(1, steps + 1):
        h, t, g, a, z, logit = _forward(p, x, counts)
        out = (_sigmoid(logit) - labels) * weight
        dz = np.repeat(out, counts)[:, None] * p["c"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}
        for k, q in p.items():
            grad = grads[k] + decay * q
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
            q -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Classifier(mean, scale, p)


def fold(id_: Column, of: int = 3) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % of


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """A classifier of ``label_col``, from ``sample_rows`` rows of ``labels`` at most; None without both labels.

    The rows are those of the smallest hashes of the id, half of each label; their ids, so bounded in number, go to
    all tasks, which encode the texts. Rows with a null id or label are left out. Further columns are ignored.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    some = [rows.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2) for k in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, counts in encode(batch.column(1).to_pylist()):
                got += [b.astype(np.float16).tobytes() for b in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.binary())], names=["label", "x"])

    # Not in the order of the tasks: sums of floats depend on it.
    found = sorted((bytes(r.x), r.label) for r in texts.mapInArrow(run, "label int, x binary").collect())
    if len({y for _, y in found}) < 2:
        return None
    bags = [np.frombuffer(x, np.float16).reshape(-1, N_FEATURES) for x, _ in found]
    return train(np.vstack(bags).astype(np.float32), np.array([len(b) for b in bags]), np.array([y for _, y in found], np.float32))


def _scores(model: Classifier | None, texts: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return np.concatenate([model.score(x, n) for x, n in encode(t.as_py() for t in texts)] or [np.empty(0)]).astype(np.float64)


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its text alone: no shuffle, a few MB of text at a time.

    Null and empty texts are one passage that holds a line end; repeated rows are scored each; null ids are kept.
    Without a model (no labels, or one kind only) every score is 0.5. An empty table gives no rows.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_scores(shared.value, batch.column(1)))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Classifier | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    field = [i for i, f in enumerate(docs.schema.fields) if f.name == text_col][0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(_scores(shared.value, batch.column(field)) >= least)
            for lo, part in enumerate(slices(iter([batch]))):
                yield part.filter(good.slice(lo * ROWS, ROWS))

    return docs.mapInArrow(run, docs.schema)
