"""Numbers of tokens of whole texts, as a public tokenizer's library gives them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a worker encodes in one call, and characters of a text beyond which it is cut.
CALL_BYTES, PIECE_CHARS = 1 << 20, 1 << 18

#: Where a byte-level tokenizer's own expression never has a match on both sides: behind anything but white space and
#: before white space; where there is none for long, between an ASCII letter and a digit, either way round.
_SPACE_CUT = re.compile(r"\S(?=[ \t\n\r])")
_CLASS_CUT = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def pieces(text: str, most: int = PIECE_CHARS, special: tuple[str, ...] = (), cut: bool = True) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters whose tokens are, together, those of ``text``.

    The first safe place beyond ``most`` characters ends a part; a text without one stays whole, as it has to be one
    word for the tokenizer. A place inside a special string is not safe.
    """
    start = 0
    while cut and len(text) - start > most:
        at = _safe(text, start + most, special)
        if at is None:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def _safe(text: str, least: int, special: tuple[str, ...]) -> int | None:
    reach = max(map(len, special), default=0)
    stop = min(len(text), least + 4096)
    for lo, hi in ((least, stop), (least, len(text))):  # near by, by either rule; then anywhere
        for rule in (_SPACE_CUT, _CLASS_CUT):
            for found in rule.finditer(text, lo, hi):
                at = found.end()
                around = text[max(0, at - reach) : at + reach]
                if not any(s in around for s in special):
                    return at
    return None


@lru_cache(maxsize=4)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], tuple[str, ...], bool]:
    """(numbers of tokens of texts, special strings, whether texts may be cut) of a tokenizer file: ``tokenizers`` reads
    .json, ``sentencepiece`` .model. No begin, end or added special token is counted, and nothing is cut or padded;
    special strings inside a text are what the library takes them for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], (), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have their own tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    added = parts.get("added_tokens") or []
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], tuple(t["content"] for t in added if t["content"]), cuttable(parts)


def cuttable(parts: dict) -> bool:
    """Whether the places that ``pieces`` knows are safe for a tokenizer file: it has no normalizer, cuts by the usual
    byte-level expression, adds no space in front, and its added tokens stand for just their own letters."""
    cuts = parts.get("pre_tokenizer") or {}
    plain = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in parts.get("added_tokens") or ())
    return not parts.get("normalizer") and cuts.get("type") == "ByteLevel" and bool(cuts.get("use_regex", True)) and not cuts.get("add_prefix_space") and plain


SCHEMA = "n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", call_bytes: int = CALL_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, in the order of the rows; nothing is shuffled.

    ``tokenizer`` is the path of a tokenizer file, present on every executor. A worker encodes calls of about
    ``call_bytes``: texts and pieces of long texts fill a call in turn, so short texts share one and a long text takes
    several, and no encoding larger than a call is held. Only lengths leave the worker.

    Null and empty texts have no bytes and no tokens; null ids and repeated rows are rows like any other; an empty table
    gives none. Texts that are not strings are cast. Other columns are ignored, whatever their names.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, special, cut = counter(tokenizer)
        for batch in batches:
            texts, totals = batch.column(1), [0] * batch.num_rows
            call: list[str] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                nonlocal held
                for row, n in zip(rows, count(call)):
                    totals[row] += n
                call.clear(), rows.clear()
                held = 0

            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if not text:
                    continue
                for piece in pieces(text, piece_chars, special, cut):
                    call.append(piece)
                    rows.append(row)
                    held += len(piece) if piece.isascii() else len(piece.encode())
                    if held >= call_bytes:
                        flush()
            if call:
                flush()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], names=schema.names)

    text = F.col(text_col).cast("string")
    sizes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), sizes.alias("n_bytes")).mapInArrow(run, schema)
