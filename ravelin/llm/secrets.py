"""Secret scans: all rules in one pass of a combined automaton, which finds where their matches end.

A match begins where the longest reversed match from there does, and reaches as far as the rule's pattern goes on from
its beginning; no pattern is searched for in a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._slices import slices
from ravelin.llm.automaton import Automaton, compile_rules


@dataclass(frozen=True)
class Rule:
    """``trigger`` goes into the automaton and matches the beginning of every match, whether it is long enough or not
    (unless a shorter one cannot hide another): a trigger that begins earlier also ends earlier. ``exact`` says how far
    the match goes on, and the least length of its group ``group`` which leftmost, non-overlapping ones are kept."""

    kind: str
    trigger: str
    exact: str
    least: int
    group: int = 0
    fold: bool = False


_NAMES, _VALUE = r"password|passwd|secret|token|api_?key", "A-Za-z0-9+/_.=-"
#: An armoured key: to the END line of its BEGIN line; where that is missing, to the end of its header lines and runs of
#: base64, of which only the last may be short. Line ends may be escaped. No part reads past the next BEGIN or END.
_BREAK = r"(?:\s|\\[nr])"
_ARMOUR = (
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END \1-----"
    rf"|(?:{_BREAK}*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\]))*+"
    rf"(?:(?:{_BREAK}*+[A-Za-z0-9+/]{{20,}}+={{0,2}})++(?:{_BREAK}++(?:[A-Za-z0-9+/]++={{1,2}}|(?<=[\nnr])[A-Za-z0-9+/]++(?=\s*?(?:[\r\n]|\\[nr]|\Z))))?)?)"
)
RULES = (
    Rule("assign", rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?[{_VALUE}]", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([{_VALUE}]+)", 6, 2, True),
    Rule("access", "AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", 24),
    # Added to the base: prefixes that services give their keys, and armoured private keys.
    Rule("forge", "gh[opsu]_[A-Za-z0-9]", "gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9]", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", _ARMOUR, 1),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, ...]:
    """One for all rules, then one a rule that reads backward."""
    return compile_rules([(r.trigger, r.fold) for r in rules]), *(compile_rules([(r.trigger, r.fold)], backward=True) for r in rules)


@lru_cache(maxsize=64)
def _exact(rule: Rule) -> re.Pattern:
    return re.compile(rule.exact, re.ASCII | re.IGNORECASE if rule.fold else re.ASCII)


def find_spans(text: str | None, rules: tuple[Rule, ...] = RULES, machines: tuple[Automaton, ...] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, index of the rule) in code points, by start, then as the rules are listed."""
    data = (text or "").encode()
    whole, *back = machines or automaton(rules)
    ends = whole.ends(data)
    if not ends:
        return []
    found, taken = [], [0] * len(rules)  # taken: the byte up to which matches of a rule reach
    wide = len(data) != len(text)
    byte = point = 0  # the code points before a byte

    def point_of(at: int) -> int:
        nonlocal byte, point
        if not wide:
            return at
        point += len(data[byte:at].decode()) if at >= byte else -len(data[at:byte].decode())
        byte = at
        return point

    for end, hit in ends:
        for i, rule in enumerate(rules):
            if not hit >> i & 1 or end <= taken[i]:
                continue
            start = back[i].longest(data, end, taken[i])
            if start is None:  # it would begin inside the match before
                continue
            m = _exact(rule).match(text, a := point_of(start))
            taken[i] = start + (len(text[a : m.end()].encode()) if wide else m.end() - a)
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((a, m.end(), i))
    return sorted(found, key=lambda s: (s[0], s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) per row, in code points, end exclusive.

    No shuffle; a row's memory is its text. Null and empty texts, and null ids, give rows with no spans. Repeated rows
    are scanned each. Other columns are ignored.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    machines = automaton(rules)  # compiled once, sent with the tasks
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": rules[i].kind, "start": a, "end": b} for a, b, i in find_spans(t.as_py(), rules, machines)] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(kind))], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def span_list(spans: str, kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` of a spans column, comma-joined; only ``kinds`` where given."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans become one. Nulls stay null."""
    machines = automaton(rules)
    field = [i for i, f in enumerate(docs.schema.fields) if f.name == text_col][0]

    def clean(text: str) -> str:
        out, end = [], 0
        spans = find_spans(text, rules, machines)
        if not spans:
            return text
        merged: list[list[int]] = []
        for a, b, _ in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[end:a], mark]
            end = b
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else clean(t) for t in batch.column(field).to_pylist()]
            yield batch.set_column(field, batch.schema.field(field), pa.array(texts, batch.schema.field(field).type))

    return docs.mapInArrow(run, docs.schema)
