"""Removing repeated byte strings across documents.

Documents that equal one of a smaller id go first. Every string of ``length`` bytes has an anchor: of the short grams in
it, the one of the least hash. Two documents that share a string share its anchor, so first only anchors are compared.
The text around anchors that several documents have is cut into pieces: the strings of one anchor's occurrence, which
overlap. Equal pieces are one. Where an anchor has unequal pieces, shards of them are Burrows-Wheeler transformed and
merged, which gives the strings that they share, and with each the least document that has it.

Documents are kept in blocks of a few MB. A block sends what it has, once, to those buckets whose anchors it has, and
each of them answers block by block. Equal pieces of an anchor cost its bucket one entry a block; unequal ones one entry
each, so an anchor with ever other text around it makes its bucket grow with the documents that have it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm import bwt
from ravelin.llm._scratch import Scratch

BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
SHARDS = 8
NO_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
_GONE = np.uint64(np.iinfo(np.uint64).max)


def _powers(n: int) -> np.ndarray:
    factors = np.full(n + 1, _BASE, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes in a row, from those of 1, 2, 4 ... bytes."""
    powers = _powers(size)
    have, width, out, reach = data.astype(np.uint64), 1, None, 0
    while True:
        if size & width:
            out, reach = (have, width) if out is None else (out[: len(data) - reach - width + 1] * powers[width] + have[reach : reach + len(data) - reach - width + 1], reach + width)
        if width * 2 > size:
            break
        have, width = have[:-width] * powers[width] + have[width:], width * 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out, done = np.minimum(out[:-step], out[step:]), done + step
    return out


def pieces(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, start, strings, document, place of the anchor) of the pieces of a block of documents that end at ``ends``: a piece is a run
    of strings, the first at ``start``, that share an occurrence of their anchor. Strings do not cross documents."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    hashes = gram_hashes(data, gram)
    # The upper 32 bits compare grams, the lower are their places: of grams that compare alike, the first is least.
    least = sliding_min((hashes >> _HALF) << _HALF | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    for end in ends[:-1].tolist():  # strings that would run into the next document
        least[max(0, end - length + 1) : end] = _GONE
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    strings = np.diff(np.append(starts, len(least)))
    anchor = least[starts]
    real = anchor != _GONE
    anchor, starts, strings = anchor[real], starts[real], strings[real]
    place = (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return hashes[place] >> np.uint64(20), starts, strings, np.searchsorted(ends, starts, "right"), place


def _blocks():
    """Documents in turn as rows (block, keys, lengths, compressed bytes): blocks are moved more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        keys, texts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            out = pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary())],
                names=["block", "keys", "sizes", "data"],
            )
            keys.clear(), texts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if texts and size + len(raw) > BLOCK_BYTES:
                    yield emit()
                    number, size = number + 1, 0
                keys.append(key), texts.append(raw)
                size += len(raw)
        if texts:
            yield emit()

    return run


class _Cut:
    """A block's distinct anchors by bucket: both passes over a block must see them in the same order. Buckets that the
    block has nothing of cost it nothing."""

    def __init__(self, data: bytes, sizes: list[int], keys: list, length: int, gram: int, buckets: int):
        self.data, self.ends = np.frombuffer(data, np.uint8), np.cumsum(sizes)
        self.anchor, self.start, self.strings, self.document, self.place = pieces(self.data, self.ends, length, gram)
        self.key = np.array([NO_ID if k is None else k for k in keys], np.int64)[self.document] if len(keys) else np.empty(0, np.int64)
        self.buckets = buckets

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors by bucket and value, the block's buckets, several documents, index of each piece)."""
        order = np.lexsort((self.key, self.anchor, self.anchor % np.uint64(self.buckets)))
        a, k = self.anchor[order], self.key[order]
        new = np.append(True, a[1:] != a[:-1]) if len(a) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        index = np.empty(len(a), np.int64)
        index[order] = np.cumsum(new) - 1
        distinct = a[first] if len(a) else a
        return distinct, _Buckets(distinct, self.buckets), k[first] != k[last] if len(a) else new, index


class _Buckets:
    """The buckets that anchors are in, which are sorted by bucket, and where each begins and ends."""

    def __init__(self, anchors: np.ndarray, buckets: int):
        of = (anchors % np.uint64(buckets)).astype(np.int64)
        self.lo = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        self.hi = np.append(self.lo[1:], len(of)) if len(of) else self.lo
        self.names = of[self.lo]

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        return zip(self.names.tolist(), self.lo.tolist(), self.hi.tolist())

    def bounds(self, bucket: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.names, bucket))
        return int(self.lo[at]), int(self.hi[at])


def _send(cut: _Cut, block: int) -> list[tuple[int, int, bytes]]:
    """A row for each bucket: the block's anchors (5 bytes of each), and which of them several of its documents have."""
    distinct, at, several, _ = cut.anchors()
    short = (distinct // np.uint64(cut.buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5] if len(distinct) else np.empty((0, 5), np.uint8)
    return [(b, block, short[lo:hi].tobytes() + np.packbits(several[lo:hi]).tobytes()) for b, lo, hi in at]


def _count_of(blob: bytes) -> int:
    n = len(blob) * 8 // 41
    while 5 * n + (n + 7) // 8 < len(blob):
        n += 1
    return n


def _shared(table: pa.Table) -> pa.Table:
    """For each block of a bucket: which of its anchors another block has too, or several of its own documents."""
    blobs = table.column("blob").to_pylist()
    counts = [_count_of(b) for b in blobs]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(b[: 5 * n] for b, n in zip(blobs, counts)), np.uint8).reshape(-1, 5)
    anchors = wide.view("<u8").ravel()
    several = np.concatenate([np.unpackbits(np.frombuffer(b[5 * n :], np.uint8), count=n).astype(bool) for b, n in zip(blobs, counts)])
    order = np.argsort(anchors, kind="stable")
    near = np.zeros(len(order), bool)
    same = anchors[order][1:] == anchors[order][:-1]
    near[1:] |= same
    near[:-1] |= same
    hit = several
    hit[order] |= near
    # An anchor of a block is in its rows once, so equal neighbours come from different blocks.
    masks = [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(hit, np.cumsum(counts)[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())}).filter(pa.array([bool(m) for m in masks]))


class _Pieces:
    """The distinct pieces of a block whose anchors are shared, by bucket."""

    def __init__(self, cut: _Cut, answers: list, length: int):
        distinct, at, _, index = cut.anchors()
        hit = np.zeros(len(distinct), bool)
        for a in answers:
            lo, hi = at.bounds(a["bucket"])
            hit[lo:hi] = np.unpackbits(np.frombuffer(a["mask"], np.uint8), count=hi - lo).astype(bool)
        chosen = np.flatnonzero(hit[index]) if len(index) else index
        self.anchor, self.start, self.strings, self.key, self.place = (x[chosen] for x in (cut.anchor, cut.start, cut.strings, cut.key, cut.place))
        self.sizes = self.strings + length - 1
        value = np.append(np.uint64(0), np.cumsum((cut.data.astype(np.uint64) + np.uint64(1)) * _powers(len(cut.data))[: len(cut.data)]))
        # The sum over a piece, moved to the power of the block's end: comparable wherever the piece lies.
        self.hash = (value[self.start + self.sizes] - value[self.start]) * _powers(len(cut.data))[len(cut.data) - self.start] if len(chosen) else self.anchor
        order = np.lexsort((self.key, self.hash, self.anchor, self.anchor % np.uint64(cut.buckets)))
        a, h = self.anchor[order], self.hash[order]
        new = np.append(True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])) if len(a) else np.empty(0, bool)
        self.first = order[new]
        self.index = np.empty(len(a), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.at = _Buckets(self.anchor[self.first], cut.buckets)

    def send(self, data: bytes, block: int) -> list[tuple[int, int, bytes]]:
        out = []
        for b, lo, hi in self.at:
            f = self.first[lo:hi]
            text = b"".join([data[s : s + n] for s, n in zip(self.start[f].tolist(), self.sizes[f].tolist())])
            numbers = (self.anchor[f], self.key[f], self.sizes[f].astype("<u2"), (self.place[f] - self.start[f]).astype("<u2"))
            out.append((b, block, np.int64(hi - lo).tobytes() + b"".join(x.tobytes() for x in numbers) + zlib.compress(text, 1)))
        return out


def _least(length: int, gram: int):
    """For each block of a bucket: per piece, runs of strings and the least key of a document that has them."""

    def run(table: pa.Table) -> pa.Table:
        anchors, keys, sizes, places, texts, counts = [], [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            anchors.append(np.frombuffer(blob, np.uint64, n, 8)), keys.append(np.frombuffer(blob, np.int64, n, 8 + 8 * n))
            size = np.frombuffer(blob, "<u2", n, 8 + 16 * n).astype(np.int64)
            sizes.append(size), counts.append(n), places.append(np.frombuffer(blob, "<u2", n, 8 + 18 * n))
            stops, text = np.cumsum(size).tolist(), zlib.decompress(blob[8 + 20 * n :])
            texts += [text[a:b] for a, b in zip([0, *stops], stops)]
        anchor, key, size, place = np.concatenate(anchors), np.concatenate(keys), np.concatenate(sizes), np.concatenate(places)
        known: dict[bytes, int] = {}
        index = np.array([known.setdefault(t, len(known)) for t in texts])
        distinct = list(known)
        least = np.full(len(distinct), NO_ID)
        np.minimum.at(least, index, key)
        first = np.full(len(distinct), len(texts))
        np.minimum.at(first, index, np.arange(len(texts)))
        runs_n, runs_key, run_count = size[first] - length + 1, least.copy(), np.ones(len(distinct), np.int64)
        mixed = _unequal(distinct, anchor[first], place[first], length, gram)
        if len(mixed):
            shard = np.searchsorted(np.cumsum(counts), first[mixed], "right") % SHARDS
            found = bwt.repeated_prefixes([distinct[i] for i in mixed], shard, length, least[mixed])
            parts_n, parts_key = [], []
            for values in found:
                starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
                parts_n.append(np.diff(np.append(starts, len(values)))), parts_key.append(values[starts])
            run_count[mixed] = [len(x) for x in parts_n]
            at = np.cumsum(run_count) - run_count
            all_n, all_key = np.zeros(run_count.sum(), np.int64), np.zeros(run_count.sum(), np.int64)
            plain = np.ones(len(distinct), bool)
            plain[mixed] = False
            all_n[at[plain]], all_key[at[plain]] = runs_n[plain], runs_key[plain]
            into = np.repeat(at[mixed], run_count[mixed]) + np.concatenate([np.arange(len(x)) for x in parts_n])
            all_n[into], all_key[into] = np.concatenate(parts_n), np.concatenate(parts_key)
            runs_n, runs_key = all_n, all_key
        at = np.cumsum(run_count) - run_count
        out, lo = [], 0
        for n in counts:
            own = index[lo : lo + n]
            c = run_count[own]
            take = np.repeat(at[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            out.append(np.int64(n).tobytes() + c.astype("<u2").tobytes() + runs_n[take].astype("<u2").tobytes() + runs_key[take].tobytes())
            lo += n
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "mask": pa.array(out, pa.binary())})

    return run


def _unequal(texts: list[bytes], anchor: np.ndarray, place: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Distinct pieces that may share a string with another: of one anchor, and alike around it, on both sides
    together, for three quarters of what a string has beyond the anchor. A string that two pieces share reaches far
    enough to the left and to the right for one of the four shares that are tried."""
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    rest = length - gram
    cuts = [round(rest * k / 4) for k in range(5)]
    shares = [(cuts[k], rest - cuts[k + 1]) for k in range(4)]
    seen: list[dict[tuple[int, bytes], int]] = [{} for _ in shares]
    maybe = np.zeros(len(texts), bool)
    for i, g, at in zip(several.tolist(), group[several].tolist(), place[several].tolist()):
        text = texts[i]
        for known, (left, right) in zip(seen, shares):
            if at >= left and len(text) >= at + gram + right:
                other = known.setdefault((g, text[at - left : at + gram + right]), i)
                if other != i:
                    maybe[i] = maybe[other] = True
    return np.flatnonzero(maybe)


def _removed(cut: _Cut, found: _Pieces, answers: list, length: int) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(cut.data) + 1, np.int64)
    count, n, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in sorted(answers, key=lambda a: a["bucket"]):
        blob = a["mask"]
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        c = np.frombuffer(blob, "<u2", k, 8).astype(np.int64)
        count.append(c), n.append(np.frombuffer(blob, "<u2", c.sum(), 8 + 2 * k).astype(np.int64)), key.append(np.frombuffer(blob, np.int64, c.sum(), 8 + 2 * k + 2 * c.sum()))
    count, n, key = np.concatenate(count), np.concatenate(n), np.concatenate(key)
    if not len(count):
        return gone[:-1] > 0
    at = np.cumsum(count) - count
    before = np.cumsum(n) - n
    c = count[found.index]
    take = np.repeat(at[found.index] - (np.cumsum(c) - c), c) + np.arange(c.sum())
    start = np.repeat(found.start, c) + before[take] - np.repeat(before[at[found.index]], c)
    less = key[take] < np.repeat(found.key, c)
    np.add.at(gone, start[less], 1)
    np.add.at(gone, (start + n[take] + length - 1)[less], -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row: each byte goes that lies in a string of
    ``length`` bytes that a document of a smaller id holds too, as the input has it.

    Nulls: a null text is empty; a null id is larger than any other. Rows that repeat an id leave each other whole.
    Texts under ``length`` bytes stay whole. A block holds a long text whole, at some 100 bytes of memory a byte. An
    empty table gives an empty result. Other columns are ignored.
    ``kept`` is what is left, as bytes, since a cut can fall inside a character.
    """
    if not 16 <= length <= 30_000:
        raise ValueError("length must be between 16 and 30000 bytes")
    spark, gram = docs.sparkSession, max(8, length // 3)
    scratch = Scratch(spark, "substrings")
    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "key": F.coalesce("id", F.lit(NO_ID))})
    # A document that equals one of a smaller id goes whole, and need not be looked into.
    again = rows.where(F.octet_length("text") >= length).groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("sha", "first")
    # Joined by sorted shuffles at every size: their number grows with the input.
    marked = rows.join(scratch.write(again, "again").hint("merge"), "sha", "left").withColumn("copy", F.coalesce(F.col("key") > F.col("first"), F.lit(False)))
    marked = scratch.write(marked.select("id", "copy", F.octet_length("text").cast("long").alias("n"), F.when(~F.col("copy"), F.col("text")).alias("text")), "marked")
    blocks = scratch.write(marked.where("NOT copy").select("id", "text").mapInArrow(_blocks(), schema), "blocks")
    copies = scratch.write(marked.where("copy").select("id", "n"), "copies")
    scratch.drop("marked")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n")).first().n or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    def cut_of(row: dict) -> _Cut:
        return _Cut(row["data"], row["sizes"], row["keys"], length, gram, buckets)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row | {"data": unpack.decompress(row["data"])}

    def send(rows_: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "block", "blob"])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            if out := _send(cut_of(row), row["block"]):
                yield send(out)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            if out := _Pieces(cut_of(row), row["answers"], length).send(row["data"], row["block"]):
                yield send(out)

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            out: list[list] = [[] for _ in range(5)]
            gone = np.zeros(len(row["data"]), bool)
            if row["answers"]:
                cut = cut_of(row)
                gone = _removed(cut, _Pieces(cut, row["answers"], length), row["runs"] or [], length)
            lo = 0
            for n in row["sizes"]:
                own, raw = gone[lo : lo + n], row["data"][lo : lo + n]
                removed = int(np.count_nonzero(own))
                if removed:
                    raw = np.frombuffer(raw, np.uint8)[~own].tobytes()
                spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
                for column, v in zip(out, (n, removed, spans, hashlib.sha256(raw).hexdigest(), raw)):
                    column.append(v)
                lo += n
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.record_batch([pa.array(row["keys"], pa.int64()), *(pa.array(c, t) for c, t in zip(out, types[: 5 if keep_text else 4]))], names=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    sent, answer = "bucket int, block long, blob binary", "block long, bucket int, mask binary"
    by_block = lambda df, name: scratch.write(df.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask")).alias(name)), name)
    answers = by_block(blocks.mapInArrow(first_pass, sent).groupBy("bucket").applyInArrow(_shared, answer), "answers")
    sent_pieces = scratch.write(blocks.join(answers.hint("merge"), "block").mapInArrow(second_pass, sent), "pieces")
    runs = by_block(sent_pieces.groupBy("bucket").applyInArrow(_least(length, gram), answer), "runs")
    scratch.drop("pieces")
    whole = blocks.join(answers.hint("merge"), "block", "left").join(runs.hint("merge"), "block", "left")
    out = whole.mapInArrow(last_pass, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
    gone = copies.select("id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if keep_text else []))
    out = out.unionByName(gone)
    return out.withColumn("id", F.col("id").cast(key)).select(names)
