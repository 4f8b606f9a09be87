"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash fingerprints in pigeonhole blocks give pairs, MinHash
bands those whose fingerprints lie further apart, and the sets themselves decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm import simhash
from ravelin.llm._graph import connected_components
from ravelin.llm._scratch import Scratch
from ravelin.llm._slices import ROWS as SLICE, slices
from ravelin.llm.simhash import BRUTE

#: A pair of similarity 0.8 agrees on none of the bands with a chance of (1 - 0.8 ** ROWS) ** BANDS, 7 in 100,000.
BANDS, ROWS = 24, 5
#: Bits in which fingerprints of candidates differ at most.
BITS = 4
BLOCK = 256  # nodes, about, of a key that are compared with as many at a time
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the shingles of a text; words as in ``simhash.fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = (ends - [len(w) + 1 for w in words]).tolist(), (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :])] or [digest(line, seed)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the ROWS least values that the set takes under as many orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        mixed = (hashes[lo : lo + 4096] ^ _RANDOM[0]) * _RANDOM[1]
        np.minimum(least, mixed.min(axis=1), out=least)
    key = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return key ^ key >> np.uint64(31)


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from (t, k, node) sorted by t and k. Of a key with at most BRUTE nodes, all pairs; of a larger one, its
    first node with each other and each with the next."""
    held: list[np.ndarray] = []

    def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def work(t, k, node) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(t)))
        size, group = np.repeat(sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((size > 1) & (size <= BRUTE))
        f, g = node[small], group[small]
        for step in range(1, min(BRUTE, len(f))):
            hit = g[step:] == g[:-step]
            yield from out(f[:-step][hit], f[step:][hit])
        for lo, n in zip(starts[sizes > BRUTE], sizes[sizes > BRUTE]):
            own = node[lo : lo + n]
            yield from out(np.concatenate([np.full(n - 1, own[0]), own[1:-1]]), np.concatenate([own[1:], own[2:]]))

    for batch in batches:
        got = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        now = [np.concatenate(x) for x in zip(held, got)] if held else got
        if not len(now[0]):
            continue
        other = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
        last = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        held = [x[last:] for x in now]
        if last:
            yield from work(*(x[:last] for x in now))
    if held:
        yield from work(*held)


def _candidates(nodes: DataFrame) -> DataFrame:
    keyed = nodes.select(F.posexplode("bands").alias("t", "k"), "node")
    return keyed.repartition("t", "k").sortWithinPartitions("t", "k", "node").mapInArrow(_pairs, "a long, b long")


def _by_fingerprint(nodes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """(a, b): the first node of a fingerprint with its others, and the first nodes of fingerprints that share a block and
    differ in at most ``distance`` bits."""
    own = scratch.write(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    near = scratch.write(simhash.link_fingerprints(own.select("fp"), distance, own.count()), "near")
    ends = [own.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    same = nodes.select("fp", "node").join(own, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    return across.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """How many hashes each set on the left has in common with each on the right, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(x) if len(x) else np.empty(0, np.uint64) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    both = np.intersect1d(flat[0], flat[1])
    at = [np.minimum(np.searchsorted(both, f), max(0, len(both) - 1)) for f in flat]
    hit = [both[a] == f if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    at, row = [a[h] for a, h in zip(at, hit)], [r[h] for r, h in zip(row, hit)]
    order = [np.argsort(a, kind="stable") for a in at]
    at, row = [a[o] for a, o in zip(at, order)], [r[o] for r, o in zip(row, order)]
    for lo in range(0, len(both), width):
        part = []
        for a, r, n in zip(at, row, out.shape):
            x, y = np.searchsorted(a, [lo, lo + width])
            part.append(np.zeros((n, width), np.float32))
            part[-1][r[x:y], a[x:y] - lo] = 1
        out += part[0] @ part[1].T
    return out


def _between(nodes: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between nodes that share a key of more than BRUTE nodes and have different roots so far.

    In each such key, the nodes that are not of its most frequent root are compared with all, in blocks: a row for each
    node and block that it meets, never one for each pair. Of two roots, one link is given for each pair of blocks.
    """
    keyed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.posexplode("bands").alias("t", "k"))
    counts = keyed.groupBy("t", "k", "root").agg(F.count("*").alias("n")).groupBy("t", "k").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    open_ = counts.where((F.col("n") > BRUTE) & (F.col("n") > F.col("most.n"))).select("t", "k", F.col("most.root").alias("most"), F.ceil(F.col("n") / BLOCK).alias("rights"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("lefts"))
    met = keyed.join(open_, ["t", "k"]).join(sets.hint("merge"), "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    series = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    right = F.transform(series("lefts"), lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), block("rights").alias("j")))
    left = F.transform(series("rights"), lambda j: F.struct(F.lit(True).alias("left"), block("lefts").alias("i"), j.alias("j")))
    places = F.concat(right, F.when(F.col("root") != F.col("most"), left).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField("left", T.BooleanType(), False), T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])))))
    met = met.select("t", "k", "node", "root", "hashes", F.explode(places).alias("x")).select("t", "k", "x.*", "node", "root", "hashes")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        read = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        size = np.array([len(x) for x in read], np.float32)
        a = b = np.empty(0, np.int64)
        if len(one) and len(two):
            both = shared([read[i] for i in one], [read[i] for i in two])
            hit = (both >= least * (size[one][:, None] + size[two] - both) - 1e-6) & (root[one][:, None] != root[two])
            i, j = np.nonzero(hit)
            _, first = np.unique(np.stack([root[one][i], root[two][j]]), axis=1, return_index=True)
            a, b = node[one][i[first]], node[two][j[first]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.groupBy("t", "k", "i", "j").applyInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda x: np.frombuffer(x.as_py(), np.uint64)
            yield batch.select(["a", "b"]).filter(pa.array([similar(read(x), read(y), least) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_()))

    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The row of the smallest id of every component of texts whose shingle sets have a Jaccard similarity of ``least``
    or more, with the columns of ``docs``; among rows that repeat that id, the first that was written.

    Texts of the same set, told apart by a 64-bit hash of it, are one node, so copies add nothing to a band or block. Pairs
    are those whose SimHash fingerprints, of the set, share a pigeonhole block and differ in at most BITS bits, and those
    that agree on a MinHash band, since similarity ``least`` reaches further than BITS; every one is decided by its sets. Null texts and those without words are alike. A null
    id is larger than any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    fields = docs.schema.fields
    field = [i for i, f in enumerate(fields) if f.name == text_col][0]
    extra = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    marked = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + extra)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t.as_py(), shingle) for t in batch.column(field)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in found), np.uint64, len(found)).view(np.int64)
            bands = [band_keys(x).view(np.int64) for x in found]
            fps = np.fromiter((simhash.of_hashes(x) for x in found), np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes), pa.array(fps), pa.array(bands, pa.list_(pa.int64()))], names=marked.names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in part.column(1)], pa.binary())], names=["node", "hashes"])

    table = scratch.write(docs.mapInArrow(mark, marked).withColumn("row", F.monotonically_increasing_id()), "rows", SLICE)
    key = F.col(f"c{[f.name for f in fields].index(id_col)}")
    order = F.struct(key.isNull().alias("none"), key.alias("id"), "row")
    first = scratch.write(table.groupBy("node").agg(F.min(order).alias("first"), F.min("row").alias("at")), "first")
    nodes = table.select("row", "fp", "bands").join(first.select("node", F.col("at").alias("row")).hint("merge"), "row").select("node", "fp", "bands")
    nodes = scratch.write(nodes, "nodes")
    pairs = scratch.write(_by_fingerprint(nodes, BITS, scratch).unionByName(_candidates(nodes)).distinct(), "pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first.select("node", F.col("at").alias("row")), "node")
    texts = table.select("row", F.col(f"c{field}").cast("string").alias("text")).join(members.hint("merge"), "row")
    sets = scratch.write(texts.select("node", "text").mapInArrow(gather, "node long, hashes binary"), "sets", SLICE)
    links = scratch.write(_verified(pairs, sets, least), "links", SLICE)
    roots = connected_components(spark, links, scratch)
    more = scratch.write(_between(nodes, roots, sets, least), "more")
    if more.limit(1).count():
        roots = connected_components(spark, scratch.write(links.unionByName(more), "all-links"), scratch)
    rooted = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = scratch.write(rooted.select("first.row"), "kept")
    scratch.drop("sets", "pairs", "nodes")
    # Joined by sorted shuffles at every size, as in simhash.
    return table.join(kept.hint("merge"), "row", "left_semi").select([F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
