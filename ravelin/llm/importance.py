"""Resampling towards a target distribution by hashed word runs: gains of buckets, weights of documents, a weighted draw."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.order import numbered
from ravelin.llm._scratch import Scratch

#: Buckets of features (16 bits name one), features of a block, and bytes of text that are cut into words at once.
BUCKETS, BLOCK_FEATURES, CUT_BYTES = 10_000, 1 << 20, 1 << 22
SEED, PERCENT, LEAST_WORDS = 7, 25, 20

#: Bytes of words as they are, A to Z as a to z, all others as spaces.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def text_buckets(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every word and of every two words that follow each other, as uint16) of a whole text.

    A checksum goes on from where it stood: that of two words is continued from the first one's. Texts are cut into
    words a few megabytes at a time.
    """
    data = text.encode().translate(_TABLE)
    found, n, start, before = [], 0, 0, None
    while start < len(data):
        stop = data.find(b" ", start + CUT_BYTES)
        stop = len(data) if stop < 0 else stop
        words = data[start:stop].split()
        start = stop
        if not words:
            continue
        own = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), own))
        pairs = [] if before is None else [crc32(words[0], before)]
        pairs += map(crc32, words[1:], spaced)
        before = spaced[-1]
        n += len(words)
        found.append((np.array(own + pairs, np.uint32) % buckets).astype("<u2"))
    return n, np.concatenate(found) if found else np.zeros(0, "<u2")


BLOCK = "words array<long>, offsets binary, stream binary"


def bucket_streams(texts: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """(ids, words, offsets, stream) of blocks of documents: the buckets of all their features one after the other as
    little-endian uint16, where each document begins in them as int64, its words, its id. A block ends with the document
    that fills it, so a task holds one block and one text; nothing is shuffled."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has 16 bits")
    schema = T.StructType([T.StructField("ids", T.ArrayType(texts.schema[id_col].dataType)), *T._parse_datatype_string(BLOCK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        ids, words, offsets, streams, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal held
            values = ([list(ids)], [list(words)], [np.array(offsets, "<i8").tobytes()], [np.concatenate(streams).tobytes()])
            ids.clear(), words.clear(), offsets.clear(), streams.clear()
            held = 0
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            keys, found = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                n, stream = text_buckets(found[row].as_py() or "", buckets)
                ids.append(keys[row].as_py())
                words.append(n)
                offsets.append(held)
                streams.append(stream)
                held += len(stream)
                if held >= block_features or len(ids) >= block_features // 64:
                    yield block()
        if ids:
            yield block()

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all streams: every block is sorted and its runs are measured; a task adds up the runs of its
    blocks, so that it sends at most ``buckets`` rows to the sum over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                stream = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                if len(stream):
                    starts = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]])
                    totals[stream[starts]] += np.diff(np.r_[starts, len(stream)])
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket, by its number, the thousandfold logarithm of how much likelier it is in the target, floored.
    At most ``buckets`` rows (65,536) come to the driver."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer").na.fill(0)
    rows = both.select("bucket", "s", "t").collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    s, t = s.astype(np.float64), t.astype(np.float64)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def document_weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document of the streams: the floored mean of its features' gains."""
    schema = T.StructType([T.StructField("id", streams.schema["ids"].dataType.elementType), *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                starts = np.frombuffer(batch.column(2)[row].as_buffer(), "<i8")
                gathered = gains[np.frombuffer(batch.column(3)[row].as_buffer(), "<u2")]
                sizes = np.diff(np.r_[starts, len(gathered)])
                weights = np.zeros(len(starts), np.int64)
                some = sizes > 0
                if some.any():
                    weights[some] = np.add.reduceat(gathered, starts[some]) // sizes[some]
                yield pa.record_batch([batch.column(0)[row].values, batch.column(1)[row].values, pa.array(sizes), pa.array(weights)], names=schema.names)

    return streams.select("ids", "words", "offsets", "stream").mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """The thousandfold of a Gumbel variate, floored, that ``seed`` and the id give; a null id is empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: ``rank`` from 1 for the ``percent`` of the documents of
    at least ``least_words`` words with the highest scores, null for all others.

    Words are runs of digits, letters from a to z (A to Z are taken as these) and all that is not ASCII. Texts are read
    once: their buckets are written to the shared folder, some two bytes a word or pair of words, and both the counts
    over the corpus and the weights are taken from there. Score is weight plus a Gumbel variate, so that the highest
    scores are a draw without replacement. They are ranked over ranges; no task sees all of them.

    Null and empty texts have no features and weight 0; they are never drawn. Repeated rows are documents of their own,
    rows of one id and score in any order; ids may be null. An empty table gives no rows, an empty target is one without
    features. Other columns are ignored, whatever their names.
    """
    streams = scratch.write(bucket_streams(docs, id_col, text_col, buckets, block_features), "streams")
    wanted = bucket_counts(bucket_streams(target, target_id, target_text, buckets, block_features), buckets)
    weighed = document_weights(streams, bucket_gains(bucket_counts(streams, buckets), wanted, buckets))
    scored = scratch.write(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    long_enough = F.col("n_words") >= least_words
    drawn = scored.where(long_enough).count() * percent // 100
    ranked = numbered(scored.where(long_enough), [F.desc("score"), F.asc("id")], "rank", scratch)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("id", "n_features", "weight", "score", "rank")
