"""Language-model scores from a probabilistic suffix tree over words, beside a word-count base.

Symbols are the words of the training texts, the end of a text, and one for all unseen words. A context is the up to
``DEPTH`` symbols before a symbol, the beginning of the text among them. It is retained if it occurs twice or more in
training and its next-symbol distribution diverges from that of its parent, the longest retained context that it ends
in: n times the Kullback-Leibler divergence must pay ``DIVERGENCE`` nats for each distinct next symbol. A symbol is
scored in the state of the longest retained suffix of what came before it, whose distribution is smoothed with its
parent's, down to that of no context, which is the base.

Nothing of the tree is broadcast or reaches the driver; it grows with the corpus. Texts are turned into written chunks
of symbol numbers once. Then, level by level, a chunk asks the buckets of its distinct grams for their counts in all of
the corpus, and the buckets of its contexts whether they are retained: both are sums of what the chunks send. One of the
chunks that have a gram is named its owner, which alone sends the gram's part of its context's divergence. A chunk asks
once for a gram, however often it has it, so the most frequent gram adds one entry a chunk to its bucket. A chunk makes
a row for each bucket that it has a gram of, so no more rows than grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._scratch import Scratch

DEPTH = 2  # symbols of the longest context
DIVERGENCE = 4.0  # nats that a context must save over its parent for each of its distinct next symbols
CHUNK = 800_000  # symbols of a chunk; a longer text is cut into pieces that begin with the symbols before them
BUCKET = 400_000  # distinct grams, about, that meet in a bucket
SLICE = 1 << 20  # bytes that are cut into words at a time

_RANDOM = np.random.default_rng(7).integers(0, 1 << 63, (2, 1 << 16), np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z are read as a-z
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES[_SPACE] = 0
END, BEGIN = np.uint64(0x51ED270B1F3C9A77), np.uint64((1 << 64) - 1)
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFF00)  # of a gram's hash, the bits that are sent


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(31)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ x >> _U(29)) * _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte at which each word starts, its 64-bit hash) of texts that lie one after another, in slices that end
    between words. A hash is a sum of random weights of bytes times random weights of their places."""
    bounds = np.zeros(len(data) + 1, bool)
    bounds[offsets] = True
    lo, size = 0, len(data)
    while lo < size:
        hi = min(size, lo + SLICE)
        while hi < size:
            cuts = np.flatnonzero(_SPACE[data[lo + 1 : hi]] | bounds[lo + 1 : hi])
            if len(cuts):
                hi = lo + 1 + int(cuts[-1])
                break
            hi = min(size, hi + SLICE)  # a word that is longer than a slice
        part = data[lo:hi]
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1] | bounds[lo + 1 : hi]
        starts = np.flatnonzero(first)
        if len(starts):
            part = part[starts[0] :]
            at = starts - starts[0]
            place = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
            weight = _RANDOM[0][place & 0xFFFF]
            if int(place.max()) > 0xFFFF:
                weight = weight + _RANDOM[1][(place >> 16) & 0xFFFF] * (place > 0xFFFF)
            yield starts + lo, mixed(np.add.reduceat(_BYTES[part] * weight, at))
        lo = hi


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all symbols of the texts one after another, how many each text has): its words, then the end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    found = list(word_hashes(data, offsets - offsets[0]))
    starts = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    words = np.diff(np.searchsorted(starts, offsets - offsets[0]))
    out = np.full(len(starts) + len(texts), END)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(words + 1) - 1] = False
    out[is_word] = np.concatenate([x for _, x in found]) if found else np.empty(0, _U)
    return out, words + 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, byte plane by byte plane."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return np.array([len(a) for a in arrays], np.uint32).tobytes() + zstandard.compress(body, 1)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, body, at, out = np.frombuffer(blob, np.uint32, len(kinds)), np.frombuffer(zstandard.decompress(blob[4 * len(kinds) :]), np.uint8), 0, []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, the number of each value among them)."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


class Chunk:
    """The symbols of some pieces of texts. ``hist`` is how many symbols before each are known, up to DEPTH, the
    beginning of its text among them; the first ``lead`` symbols of a piece are known only as what came before."""

    def __init__(self, blob: bytes, depth: int):
        gaps, number, ranks, sizes, lead, train = unpack(blob, "u8", "u4", "u4", "u4", "u1", "?")
        self.words, self.ids = np.cumsum(gaps, dtype=_U), number[ranks].astype(np.int64)
        sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        place = np.arange(len(self.ids)) - np.repeat(self.starts, sizes)
        lead = np.repeat(lead.astype(np.int64), sizes)
        self.own = place >= lead
        self.first = (place == 0) & (lead == 0)
        self.hist = np.minimum(place + (lead == 0), depth).astype(np.int8)
        self.train = np.repeat(train, sizes) & self.own

    def grams(self, k: int, before: np.ndarray) -> np.ndarray:
        """56-bit hashes of every symbol with the k before it, from those with k - 1; right where ``hist`` is k or more."""
        shifted = np.concatenate([[BEGIN], before[:-1]])
        if k == 1:
            shifted[self.first] = BEGIN
        return mixed(shifted * _U(0xD6E8FEB86659FD93) + self.words[self.ids] + _U(k)) & _TOP

    def shifted(self, k: int, values: np.ndarray, begin: int) -> np.ndarray:
        """The value of the context of k symbols before each symbol, where the values are those of grams of k symbols."""
        out = np.concatenate([[begin], values[:-1]])
        if k == 1:
            out[self.first] = begin
        return out


def chunks(rows: DataFrame, depth: int, size: int) -> DataFrame:
    """Written form of (id, train, text): a row for each chunk, with the ids and row numbers of its pieces."""
    kinds = "chunk long, blob binary, rows array<long>, tokens long, texts long"
    schema = T.StructType([*T._parse_datatype_string(kinds).fields, T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, row = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []  # (symbols, lead, train, id, row)

        def flush() -> pa.RecordBatch:
            nonlocal made
            words, ids = numbered(np.concatenate([h[0] for h in held]))
            sizes, lead, train = (np.array(x) for x in zip(*((len(h[0]), h[1], h[2]) for h in held)))
            number = np.argsort(-np.bincount(ids), kind="stable").astype(np.uint32)  # frequent words get small ranks, which pack well
            ranks = np.empty(len(words), np.uint32)
            ranks[number] = np.arange(len(words), dtype=np.uint32)
            blob = pack(np.diff(words, prepend=_U(0)), number, ranks[ids], sizes.astype(np.uint32), lead.astype(np.uint8), train.astype(bool))
            given = pa.concat_arrays([h[3] for h in held])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([(task << 32) + made]), pa.array([blob], pa.binary()), one(pa.array([h[4] for h in held], pa.int64())), pa.array([int(((sizes - lead) * train).sum())]), pa.array([int((train & (lead == 0)).sum())]), one(given)]
            made += 1
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found, counts = symbols(part.column(2))
                at = 0
                for i, (n, train) in enumerate(zip(counts.tolist(), part.column(1).to_pylist())):
                    done = 0
                    while done < n:
                        if total >= size:
                            yield flush()
                            total = 0
                        take, lead = min(n - done, size - total), min(done, depth)
                        held.append((found[at + done - lead : at + done + take].copy(), lead, train, part.column(0).slice(i, 1), (task << 40) + row))
                        total, done = total + take, done + take
                    at, row = at + n, row + 1
        if held:
            yield flush()

    return rows.select("id", "train", "text").mapInArrow(run, schema)


ASKED = "chunk long, kind int, bucket long, blob binary"
TOLD = ASKED + ", known long"


def asked(chunk: int, kind: int, bits: int, hashes: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket that the sorted hashes touch."""
    bucket = (hashes >> _U(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(hashes) else np.empty(0, np.int64)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)]):
        yield chunk, kind, int(bucket[lo]), pack(np.diff(hashes[lo:hi], prepend=_U(0)), *(v[lo:hi] for v in values))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def settle(requests: DataFrame, divergence: float) -> DataFrame:
    """What each chunk is told by the buckets that it has asked: of grams (even kinds) twice their counts in training,
    plus one for their owner; of contexts (odd kinds) their distinct next symbols, or 0 if they are not retained."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        order = np.argsort(table.column("chunk").to_numpy())
        table = table.take(order)
        parts = [unpack(b.as_py(), "u8", *(("u4", "f4") if kind % 2 else ("u8",))) for b in table.column("blob")]
        sizes = [len(p[0]) for p in parts]
        hashes = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        sent = [np.concatenate([p[i] for p in parts])[order] for i in range(1, len(parts[0]))]
        del parts, hashes
        total = np.add.reduceat(sent[0], starts, dtype=_U)
        if kind % 2:
            answer = np.where(np.add.reduceat(sent[1], starts, dtype="f8") >= divergence * total, total, _U(0))[group]
        else:
            has = sent[0] > 0
            before = np.cumsum(has) - has
            answer = (total << _U(1))[group] | (has & (before == before[starts][group])).astype(_U)
        out = np.empty(len(order), _U)
        out[order] = answer
        told = [(c, kind, bucket, pack(x), None) for c, x in zip(table.column("chunk").to_pylist(), np.split(out, np.cumsum(sizes)[:-1]))]
        if kind == 0:
            told.append((-1, 0, bucket, None, int(np.count_nonzero(total))))
        return pa.Table.from_batches([batch_of(told, TOLD)])

    return requests.groupBy("kind", "bucket").applyInArrow(run, TOLD)


def walk(chunk: Chunk, told: dict[int, np.ndarray], level: int, words: int, kinds: int, texts: int, depth: int, ask: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """(count of each symbol, its probability), as far as the chunk has been told: of grams up to ``level`` and of
    contexts below it, where it had any to ask about. ``ask`` gets what it must ask next."""
    nothing = np.empty(0, _U)
    n = seen = (told[0] >> _U(1))[chunk.ids]
    p = (seen + 1.0) / (words + kinds + 1)
    below, number, names = chunk.words[chunk.ids], chunk.ids, chunk.words  # names: hashes of the grams of a level less
    for k in range(1, depth + 1):
        of = chunk.shifted(k, n, texts)  # occurrences of the context
        below = chunk.grams(k, below)
        at = np.flatnonzero((chunk.hist >= k) & ((of >= 2) | (k == 1)))
        here, index = numbered(below[at])
        if k > level:
            ask(2 * k, here, np.bincount(index[chunk.train[at]], minlength=len(here)).astype(_U))
            break
        answer = told.get(2 * k, nothing)
        total = answer >> _U(1)
        context = chunk.shifted(k, number, len(names))
        alive = np.flatnonzero((of[at] >= 2) & chunk.own[at])
        on = at[alive]
        used = np.zeros(len(names) + 1, bool)
        used[context[on]] = True
        if k < level:
            distinct = np.zeros(len(used))
            distinct[used] = told.get(2 * k + 1, nothing)
            t, before = distinct[context[on]], p[on]
            p[on] = np.where(t > 0, (total[index[alive]] + t * before) / (of[on] + t), before)
        else:
            place = np.full(len(here), -1)  # one of each gram in training
            learned = alive[chunk.train[on]]
            place[index[learned]] = at[learned]
            mine = np.flatnonzero((answer & _U(1)).astype(bool) & (place >= 0))
            place, many = place[mine], total[mine].astype(np.float64)
            distinct = np.bincount(context[place], minlength=len(used))
            saved = np.bincount(context[place], many * np.log(many / of[place] / p[place]), len(used))
            ask(2 * k + 1, np.append(names, BEGIN)[used], distinct[used].astype("u4"), saved[used].astype("f4"))
        n = np.zeros(len(chunk.ids), _U)
        n[at] = total[index]
        number = np.zeros(len(chunk.ids), np.int64)
        number[at] = index
        names = here
    return seen, p


def fold(id_: Column, of: int = 7) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % of


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, divergence: float = DIVERGENCE, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Counts and the tree are learned from the rows where ``train`` holds. Words are told apart by a 64-bit hash.

    Nulls: a null text is empty (the end alone); a null ``train`` counts as true; null ids keep their rows. Repeated
    rows are counted and scored each. Long texts are cut into pieces whose scores are summed; what a task holds does not
    grow with a text beyond its bytes. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix-tree")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).cast("string").alias("text"))
    table = scratch.write(chunks(rows, depth, chunk), "chunks")
    sums = table.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    words, texts = sums.tokens or 0, sums.texts or 0
    bits = max(1, int(np.ceil(np.log2(max(2, words / bucket)))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = Chunk(blob.as_py(), depth)
                counts = np.bincount(c.ids[c.train], minlength=len(c.words)).astype(_U)
                yield batch_of(list(asked(name, 0, bits, c.words, counts)), ASKED)
                if depth:
                    here, index = numbered(c.grams(1, c.words[c.ids])[at := c.hist >= 1])
                    yield batch_of(list(asked(name, 2, bits, here, np.bincount(index[c.train[at]], minlength=len(here)).astype(_U))), ASKED)

    told = [scratch.write(settle(table.select("chunk", "blob").mapInArrow(first, ASKED), divergence), "told0")]
    kinds = told[0].where("kind = 0 and chunk = -1").agg(F.sum("known").alias("n")).first().n or 0

    def together(*extra: str) -> DataFrame:
        out = table.select("chunk", F.lit(-1).cast("int").alias("kind"), F.lit(-1).cast("long").alias("bucket"), "blob", *extra)
        nothing = [F.lit(None).cast(table.schema[x].dataType).alias(x) for x in extra]
        for t in told:
            out = out.unionByName(t.where("chunk >= 0").select("chunk", "kind", "bucket", "blob", *nothing))
        return out.groupBy("chunk")

    def read(t: pa.Table) -> tuple[int, Chunk, dict[int, np.ndarray]]:
        parts: dict[int, list] = {}
        for kind, b, blob in sorted(zip(t.column("kind").to_pylist(), t.column("bucket").to_pylist(), t.column("blob")), key=lambda x: x[:2]):
            parts.setdefault(kind, []).append(blob.as_py())
        own = Chunk(parts.pop(-1)[0], depth)
        return t.column("chunk")[0].as_py(), own, {k: np.concatenate([unpack(x, "u8")[0] for x in v]) for k, v in parts.items()}

    def more(level: int) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            name, own, answers = read(t)
            out: list[tuple] = []
            walk(own, answers, level, words, kinds, texts, depth, lambda kind, hashes, *values: out.extend(asked(name, kind, bits, hashes, *values)))
            return pa.Table.from_batches([batch_of(out, ASKED)])

        return run

    for k in range(1, depth + 1):
        told.append(scratch.write(settle(together().applyInArrow(more(k), ASKED), divergence), f"told{k}"))

    numbers = "`row` long, train boolean, n_tokens long, n_known long, base double, score double"
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string(numbers).fields])

    def last(t: pa.Table) -> pa.Table:
        _, own, answers = read(t)
        seen, p = walk(own, answers, depth + 1, words, kinds, texts, depth, None)
        at = np.flatnonzero([x is not None for x in t.column("rows").to_pylist()])[0]
        add = lambda x: np.add.reduceat(np.where(own.own, x, 0), own.starts)
        base = np.log10(seen + 1.0) - np.log10(words + kinds + 1)
        flags = np.add.reduceat(own.train.astype(np.int64), own.starts) > 0
        cols = [t.column("ids")[at].values, t.column("rows")[at].values, pa.array(flags), pa.array(add(1).astype(np.int64)), pa.array(add(seen > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.table(cols, names=schema.names)

    pieces = together("rows", "ids").applyInArrow(last, schema)
    out = pieces.groupBy("row").agg(F.first("id").alias("id"), F.first("train").alias("train"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("id", "train", "n_tokens", "n_known", F.lit(words).cast("long").alias("train_tokens"), "base_score", "score")
