"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._graph import connected_components
from ravelin.llm._scratch import Scratch

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)
_POWER = np.uint64(1) << np.arange(64, dtype=np.uint64)
BRUTE = 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: words in lower-case A-Z, shingles of ``shingle`` words with repeats, XXH64 votes.

    A text with fewer words has one shingle, one without words (or null) the fingerprint zero.
    """
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.array([digest(line[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :])] or [digest(line, seed)], np.uint64))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them. None give zero."""
    places = hashes.view(np.uint8).reshape(-1, 8) + _PLACE
    votes = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(_POWER[(2 * votes > len(hashes)).ravel()].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def block_plan(n: int, distance: int) -> list[int]:
    """Bit masks such that two fingerprints within ``distance`` agree on at least one of them.

    The 64 bits are cut into b blocks; with at most ``distance`` of them touched, some b - distance blocks agree.
    b grows with the number of fingerprints: more, narrower tables when chance partners would outnumber the keys.
    """
    def cost(b: int) -> float:
        return comb(b, distance) * (1 + n / 2 ** (64 * (b - distance) / b))

    b = min(range(distance + 1, distance + 6), key=cost)
    cuts = [round(64 * i / b) for i in range(b + 1)]
    blocks = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, b - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one key: each found fingerprint leaves the rest, so no pairs pile up."""
    rest, a, b = fps.copy(), [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), at)), b.append(hit)
                front.extend(hit)
                rest = rest[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def work(table, key, fps):
            new = np.ones(len(fps), bool)
            new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fps)))
            size, a, b = np.repeat(sizes, sizes), [], []
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.flatnonzero((size > 1) & (size <= BRUTE))
            f, g = fps[small], group[small]
            for step in range(1, BRUTE):
                hit = (g[step:] == g[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= distance) if len(f) > step else np.zeros(0, bool)
                a.append(f[:-step][hit] if len(f) > step else f[:0]), b.append(f[step:][hit] if len(f) > step else f[:0])
            for lo, n in zip(starts[sizes > BRUTE], sizes[sizes > BRUTE]):
                x, y = group_links(fps[lo : lo + n], distance)
                a.append(x), b.append(y)
            return pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

        for batch in batches:
            got = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            t, k, f = (np.concatenate(x) for x in zip(held, got))
            if not len(f):
                continue
            last = len(f) - int(np.argmax(((t != t[-1]) | (k != k[-1]))[::-1])) if ((t != t[-1]) | (k != k[-1])).any() else 0
            held = [t[last:], k[last:], f[last:]]
            if last:
                yield work(t[:last], k[:last], f[:last])
        if len(held[2]):
            yield work(*held)

    return run


def link_fingerprints(fps: DataFrame, distance: int, n: int) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``.

    Rows of a block's key are sorted together and streamed; a key's rows are distinct fingerprints, which many
    copies of a document do not add to.
    """
    tables = [F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block_plan(n, distance))]
    keyed = fps.select(F.explode(F.array(*tables)).alias("x"), "fp").select("x.t", "x.k", "fp")
    return keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_links(distance), "a long, b long").distinct()


def _components(distinct: DataFrame, max_distance: int, scratch: Scratch) -> DataFrame:
    """(fp, first, root) for a written table of distinct fingerprints (fp, first): root is the same in a component."""
    links = link_fingerprints(distinct.select("fp"), max_distance, distinct.count())
    roots = connected_components(distinct.sparkSession, links, scratch).withColumnRenamed("node", "fp")
    return scratch.write(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id reachable through fingerprints that differ in
    at most ``max_distance`` bits, the row's own included.

    Nulls: a null text has the fingerprint zero; a null id takes part, but is never a component_id unless the
    component has no other. Repeated rows and ids keep their rows. An empty table gives an empty result. Other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fp")
    distinct = scratch.write(table.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    rooted = _components(distinct, max_distance, scratch)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id")
    return table.join(label, F.col("fp") == F.col("fp_")).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4) -> DataFrame:
    """The row of the smallest id of every component, with the columns of ``docs``; among rows that repeat that id,
    the first that was written. A null id is larger than any other here."""
    fields = docs.schema.fields
    field = [i for i, f in enumerate(fields) if f.name == text_col][0]
    marked = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(field)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=marked.names)

    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.write(docs.mapInArrow(run, marked).withColumn("row", F.monotonically_increasing_id()), "rows")
    key = F.col(f"c{[f.name for f in fields].index(id_col)}")
    order = F.struct(key.isNull().alias("none"), key.alias("id"), "row")
    rooted = _components(scratch.write(table.groupBy("fp").agg(F.min(order).alias("first")), "distinct"), max_distance, scratch)
    kept = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row"), "kept")
    # Joined by sorted shuffles at every size: the rows that are kept soon outgrow what may be sent to all tasks.
    return table.join(kept.hint("merge"), "row", "left_semi").select([F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
