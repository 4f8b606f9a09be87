"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._slices import slices

CAPACITY = 2048
END = 1
BLOCK_TOKENS = 1 << 20
KEPT = 50_000  # words that a worker remembers from task to task


@dataclass(frozen=True)
class Cost:
    """Attention over a piece costs ``linear`` a token and ``quadratic`` a pair of tokens of the same piece."""

    linear: float = 1.0
    quadratic: float = 1 / 2048

    def of(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def _byte_letters() -> str:
    """Byte-level vocabularies write a byte as a printable letter: itself, or one of those from 256 on in turn. The
    space stays, it parts words here."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    later = iter(range(256, 512))
    letters = [chr(b if b in shown else next(later)) for b in range(256)]
    letters[32] = " "
    return "".join(letters)


#: How the tokenizer files that can be read word by word normalise and cut.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(parts: dict) -> bool:
    """Whether a tokenizer file is one whose ids can be remembered word by word."""
    normal, cuts, model = ((parts.get(k) or {}) for k in ("normalizer", "pre_tokenizer", "model"))
    cuts = cuts.get("pretokenizers") or [{}, {}]
    return (
        normal.get("normalizers") == NORMALIZERS
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": WORD_CUT}, "Removed", True)
        and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in parts.get("added_tokens") or ())
    )


@lru_cache(maxsize=2)
def word_tokenizer(path: str, held: int = 450_000) -> Callable[[list[str]], list[bytes]]:
    """Token ids, as little-endian unsigned 32-bit bytes, of texts: those of the tokenizer file, special tokens that
    stand in a text included. Files that cut otherwise than by words go through the tokenizer as they are.

    No pre-token crosses white space, so ids are remembered by what stands between it, and below that by pre-token
    (the first ``held`` of either, later ones for one call only), in the dicts ``memory`` of the function, of which a
    task leaves the first ``KEPT``, mostly frequent ones, when it ends: the worker goes on to other work. New pre-tokens go to
    the tokenizer's model together, already normalised and cut. What could change its cut when it is normalised goes
    to the tokenizer as it is.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have their own tasks
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    if not by_words(parts):
        plainly = lambda texts: [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        plainly.memory = ()
        return plainly
    added = [t["content"] for t in parts["added_tokens"]]
    parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    bare = Tokenizer.from_str(json.dumps(parts))
    chunks: dict[bytes, bytes] = {}
    words: dict[str, bytes] = {}
    letters = _byte_letters()
    plain = re.compile(r"[\x00-\x1b\x20-\x7f¡-¬®-´¶-įıĲ-ĿŁ-ž]*")  # composed, stays so, lower case keeps its length
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\s\w]|_)+|\n")
    ends = np.array([(whole.id_to_token(i) or "").endswith("</w>") for i in range(whole.get_vocab_size())])

    def ids(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_words(new: list[str]) -> None:
        """One call for many words: each is one pre-token, so its ids end at the next that ends a word."""
        line = codecs.charmap_decode(" ".join(new).encode(), "strict", letters)[0]
        got = np.array(bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(ends[got]) + 1).tolist()
        if len(stops) != len(new):
            words.update((w, ids(w)) for w in new)
            return
        raw = got.tobytes()
        words.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(new, [0, *stops], stops))

    def learn(new: list[bytes]) -> list[str]:
        lines = b"\n".join(new).decode()
        if not plain.fullmatch(lines) or any(a in lines for a in added):
            odd = [c for c in new if not plain.fullmatch(t := c.decode()) or any(a in t for a in added)]
            chunks.update((c, ids(c.decode())) for c in odd)
            new = list(set(new).difference(odd))
            lines = b"\n".join(new).decode()
        found = cut.findall(lines.lower())
        missing = list(set(found).difference(words, "\n"))
        for lo in range(0, len(missing), 4000):
            learn_words(missing[lo : lo + 4000])
        own: list[bytes] = []
        at = iter(new)
        for w in found:
            if w == "\n":
                chunks[next(at)] = b"".join(own)
                own = []
            else:
                own.append(words[w])
        for last in at:
            chunks[last] = b"".join(own)
        return missing

    def encode(texts: list[str]) -> list[bytes]:
        found = [t.encode().split() for t in texts]  # at ASCII white space
        new = list(set().union(*found).difference(chunks))
        brief = learn(new) if new else []
        out = [b"".join([chunks[c] for c in f]) for f in found]
        for memory, keys in ((chunks, new), (words, brief)):
            if len(memory) > held:
                for k in keys:
                    memory.pop(k, None)
        return out

    encode.memory = (chunks, words)
    return encode


def plan_block(lengths: list[int], capacity: int = CAPACITY, cost: Cost = Cost()) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a block of documents; no sequence is padded.

    The block's tokens give so many full sequences, and one of each power of two in what is left. Whole sequences
    are first cut off documents longer than that. What remains goes, longest first, to the sequence of the lowest
    estimated cost among those with room for it; a document that fits in none is cut to fill the cheapest ones.
    """
    total = sum(lengths)
    pieces, sequence = [], 0
    rest = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start > capacity:
            pieces.append((doc, start, capacity, sequence, 0))
            sequence, start = sequence + 1, start + capacity
        if n > start:
            rest.append((n - start, doc, start))
    left = total - sequence * capacity
    rooms = [capacity] * (left // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> b & 1]
    used, free, costs = [0] * len(rooms), np.array(rooms, np.int64), np.zeros(len(rooms))
    heap = [(0.0, i) for i in range(len(rooms))]
    rest.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in rest:
        while n:
            while heap[0][0] != costs[heap[0][1]] or not free[heap[0][1]]:  # full, or its cost has risen since
                heapq.heappop(heap)
            i = heap[0][1]
            if free[i] < n:  # the cheapest has no room for it: the cheapest of all that have, if any
                able = np.flatnonzero(free >= n)
                i = int(able[np.argmin(costs[able])]) if len(able) else i
            take = min(n, int(free[i]))
            pieces.append((doc, start, take, sequence + i, used[i]))
            used[i] += take
            free[i] -= take
            costs[i] += cost.of(take)
            n, start = n - take, start + take
            if free[i]:
                heapq.heappush(heap, (float(costs[i]), i))
    return pieces


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, cost: Cost = Cost(), keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece.

    ``tokenizer`` is the path of a tokenizer file, present on every executor. A document's tokens are its ids and the
    end id. Blocks of about ``block_tokens`` tokens of one partition are packed on their own, so nothing is shuffled
    and a task holds one block; a longer document is a block by itself. A sequence id is the partition's number in
    the high bits and a count in the low 40.

    Null and empty texts have the end id only; null ids and repeated rows are documents like any other. An empty table
    gives no pieces. Other columns are ignored.
    """
    fields = [T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(SCHEMA).fields]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        block: list[bytes] = []
        ids: list = []

        def emit() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(b) // 4 for b in block]
            pieces = sorted(plan_block(lengths, capacity, cost))
            columns = list(zip(*pieces))
            cut = [block[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            out = [
                pa.array([ids[d] for d in columns[0]], id_type),
                pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                pa.array([lengths[d] for d in columns[0]], pa.int64()),
                pa.array([sequence + q for q in columns[3]], pa.int64()), pa.array(columns[4], pa.int64()),
            ]
            sequence += max(columns[3]) + 1
            block.clear(), ids.clear()
            return pa.record_batch(out + ([pa.array(cut, pa.binary())] if keep_ids else []), names=[f.name for f in fields])

        held = 0
        try:
            for part in slices(batches, 100):
                id_type = part.schema.field(0).type
                for key, tokens in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    block.append(tokens + end)
                    ids.append(key)
                    held += len(block[-1]) // 4
                    if held >= block_tokens:
                        yield emit()
                        held = 0
            if block:
                yield emit()
        finally:
            for known in encode.memory:
                early = list(islice(known.items(), KEPT))
                known.clear()
                known.update(early)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
