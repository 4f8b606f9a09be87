"""Benchmark decontamination by greedy string tiling over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._scratch import Scratch
from ravelin.llm._slices import slices

TILE_WORDS, COVERAGE = 3, 0.8
BLOCK_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits part words."""
    return (text or "").lower().encode().translate(_TABLE).split()


def window_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of ``size`` ids that start at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + ids[at + j].astype(np.uint64)
    return out


def known_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` ids in a row are all known (not zero)."""
    if len(ids) < size:
        return np.empty(0, np.int64)
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    return np.flatnonzero(known[size:] - known[:-size] == size)


class Rolling:
    """Karp-Rabin hashes of all windows of any size, from running sums: those of a size cost one look at each word."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        spread ^= spread >> np.uint64(29)
        power = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)), dtype=np.uint64)
        self.back = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * power[:-1], dtype=np.uint64)])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]


def tile(text: np.ndarray, item: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """(place in text, place in item, words): longest matches first, none overlapping an earlier one on either side.

    The greatest length at which unmarked windows of both hash alike is searched by halving; matches of that length
    are marked from the left, each at the first place in the item that is still free and truly alike. Ties go to the
    earlier place in the text, then in the item. No pairs of windows are listed: memory is that of text and item.
    """
    if min(len(text), len(item)) < least:
        return []
    free = [text > 0, np.ones(len(item), bool)]
    rolling, tiles, most = [Rolling(text), Rolling(item)], [], len(item)

    def places(size: int) -> list[np.ndarray]:
        """Starts of windows of free words, of the text only those that the item seems to have."""
        out = []
        for f in free:
            ahead = np.concatenate([[0], np.cumsum(f)])
            out.append(np.flatnonzero(ahead[size:] - ahead[:-size] == size) if len(f) >= size else np.empty(0, np.int64))
        out[0] = out[0][np.isin(rolling[0].windows(out[0], size), rolling[1].windows(out[1], size))]
        return out

    while most >= least and free[1].any():
        lo, hi = least - 1, most  # a common window of lo words exists, or is not asked for
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(places(mid)[0]) else (lo, mid - 1)
        if lo < least:
            break
        at, of = places(lo)
        by: dict[int, list[int]] = {}
        for h, y in zip(rolling[1].windows(of, lo).tolist(), of.tolist()):
            by.setdefault(h, []).append(y)
        end = 0
        for h, x in zip(rolling[0].windows(at, lo).tolist(), at.tolist()):
            if x < end or not (left := by.get(h)):
                continue
            left[:] = [y for y in left if free[1][y : y + lo].all()]
            if (y := next((y for y in left if np.array_equal(text[x : x + lo], item[y : y + lo])), None)) is not None:
                free[0][x : x + lo] = free[1][y : y + lo] = False
                tiles.append((x, y, lo))
                end = x + lo
        most = lo - 1
    return tiles


@dataclass
class Block:
    """Some benchmark items: their vocabulary, their words as ids, and their sorted window hashes."""

    keys: list
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)

    def __init__(self, rows: list[tuple[object, list[bytes]]], least: int):
        self.keys, self.vocabulary, self.items, self.least = [k for k, _ in rows], {}, [], least
        for _, words in rows:
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        hashes = [window_hashes(x, np.arange(len(x) - least + 1), least) for x in self.items]
        sizes = [len(h) for h in hashes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], np.repeat(np.arange(len(self.items)), sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, np.int64)])[order]

    def matches(self, text: str | None, coverage: float) -> Iterator[tuple[object, float, int, int]]:
        """(item, coverage, tiles, words in tiles) of the items that ``text`` covers far enough.

        An item is tiled where the windows of ``least`` words that it shares with the text cover it far enough: tiles
        consist of such windows, so they cannot cover more.
        """
        get, least = self.vocabulary.get, self.least
        ids = np.array([get(w, 0) for w in tokens(text)], np.int64)
        at = known_windows(ids, least)
        if not len(at):
            return
        seeds = np.unique(window_hashes(ids, at, least))
        lo, hi = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        n = hi - lo
        if not n.any():
            return
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((self.place[hit], self.owner[hit]))
        owner, place = self.owner[hit][order], self.place[hit][order]
        new = np.full(len(hit), least)  # words that a window covers beyond the one before it
        new[1:] = np.where(owner[1:] == owner[:-1], np.minimum(least, np.diff(place)), least)
        found, start = np.unique(owner, return_index=True)
        for i, words in zip(found.tolist(), np.add.reduceat(new, start).tolist()):
            item = self.items[i]
            if words < coverage * len(item):
                continue
            tiles = tile(np.where(np.isin(ids, item), ids, 0), item, least)
            words = sum(x[2] for x in tiles)
            if words >= coverage * len(item):
                yield self.keys[i], words / len(item), len(tiles), words


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text, hash) of every item; a null text is empty."""
    items = benchmark.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return items.withColumn("hash", F.xxhash64("text"))


def blocks(items: DataFrame, least: int, block_bytes: int, scratch: Scratch) -> Iterator[Callable[[], Block]]:
    """The distinct texts of the benchmark, under their hashes, in blocks of about ``block_bytes`` bytes; each is read
    when it is called.

    Which block an item is in follows from its hash. The distinct texts are written once, a folder for each block.
    """
    distinct = items.groupBy("hash").agg(F.first("text").alias("text"))
    total = distinct.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = max(1, -(-total // block_bytes))
    path = scratch.path("items")
    distinct.withColumn("block", F.pmod("hash", F.lit(count))).write.mode("overwrite").partitionBy("block").parquet(path)
    stored = items.sparkSession.read.schema("hash long, text string, block long").parquet(path)

    def read(k: int) -> Block:
        rows = stored.where(F.col("block") == k).collect()
        return Block([(r.hash, words) for r in rows if len(words := tokens(r.text)) >= least], least)

    for k in range(count):
        yield lambda k=k: read(k)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = TILE_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, coverage, tiles, words) for every document and item whose tiles cover ``coverage`` of the item.

    Seeds and tiles have ``least`` words or more, so passages that were cut and reordered count in full. The benchmark
    is a set of questions to the corpus: the documents are read once for each block of it and never shuffled, what a
    block finds is written, and the block leaves the executors before the next one is sent. So one block of
    ``block_bytes`` is all that a task, or the driver, holds of a benchmark of any size (an item longer than that is
    held whole). A very long text costs its task some ten numbers a word, whatever it has in common with an item.

    Nulls: null texts are empty and match nothing; null ids are kept. Items under ``least`` words have no tile and
    match nothing. Repeated rows and items give a row each; ties of tiles go to the earlier place. Empty tables give an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tiling")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("hash long, coverage double, tiles long, words long").fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items_of(benchmark, item_col, item_text_col)
    found = []
    for k, read in enumerate(blocks(items, least, block_bytes, scratch)):
        shared = spark.sparkContext.broadcast(read())
        scratch.write(rows.mapInArrow(_pairs(shared, coverage), schema), f"found/block={k}")
        shared.destroy()
        found.append(scratch.path(f"found/block={k}"))
    return spark.read.schema(schema).parquet(*found).join(items.select("hash", F.col("key").alias("item")), "hash").select("id", "item", "coverage", "tiles", "words")


def _pairs(shared, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            got = [(k, m) for k, m in enumerate(list(block.matches(t.as_py(), coverage)) for t in batch.column(1)) if m]
            at = pa.array([k for k, m in got for _ in m], pa.int64())
            flat = list(zip(*(x for _, m in got for x in m))) or [[], [], [], []]
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c, k) for c, k in zip(flat, kinds))], names=["id", "hash", "coverage", "tiles", "words"])

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", least: int = TILE_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that cover no item far enough, with all their columns.

    Between blocks of the benchmark the rows that are left are written, so each block meets only what the ones before
    it left, and one block at a time is with the executors; that of the last stays while the result is read. Nulls,
    ties and empty tables: as in ``find_contamination``.
    """
    spark, out, scratch = docs.sparkSession, docs, Scratch(docs.sparkSession, "tiling")
    field_ = [i for i, f in enumerate(docs.schema.fields) if f.name == text_col][0]
    item_id = next(f.name for f in benchmark.schema.fields)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([next(shared.value.matches(t.as_py(), coverage), None) is None for t in batch.column(field_)], pa.bool_()))

        return run

    todo = list(blocks(items_of(benchmark, item_id, item_text_col), least, block_bytes, scratch))
    for k, read in enumerate(todo):
        shared = spark.sparkContext.broadcast(read())
        out = out.mapInArrow(keep(shared), docs.schema)
        if k + 1 < len(todo):
            out = scratch.write(out, f"kept-{k}")
            shared.destroy()
            scratch.drop(f"kept-{k - 1}")
    return out
