"""Repair of the structure of conversations: what is wrong with their rows, and the cheapest edits that set it right."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.earley import ROLES, Chart, Row, parse

#: What an undeleted truncated row costs more. Conversations up to so many rows are parsed at once, and so many
#: results are remembered, as most short conversations are alike in their roles; longer ones are decided as they come.
TRUNCATED, AT_ONCE, REMEMBERED = 3, 64, 50_000
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WORD = r"[^\x20\x09-\x0D]"
BATCH_ROWS = 2000


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present) with the faults that crc32 of ``conv:turn`` modulo 20 deals out: 0 drops a row
    (it stays, without text and not ``present``), 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a
    user's. Nulls are one space, in the key as well; a null turn stays null."""
    blank = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    dealt = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"), fault.alias("fault"))
    kept = F.when(F.col("fault") < 2, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = dealt.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), kept.alias("text"), (F.col("fault") != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_"))
    return changed.drop("_")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, with the first fault of each as b, d, t or nothing. One shuffle: both
    sorts are within its partitions and spill."""
    blank = F.lit(" ")
    own = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.coalesce("present", F.lit(True)).alias("present"))
    own = own.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy("turn")) > 1
    cut = ~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~F.col("text").rlike(WORD), "b").when(seen, "d").when(cut, "t").otherwise("")
    return own.withColumn("fault", fault).sortWithinPartitions("conv", "turn", "role", "text")


@lru_cache(maxsize=REMEMBERED)
def _parsed(letters: str, faults: str) -> tuple[int, str]:
    return parse([_row(a, f) for a, f in zip(letters, faults)])


def _row(letter: str, fault: str) -> Row:
    return Row(letter, fault in ("b", "d"), TRUNCATED if fault == "t" else 0)


class Repair:
    """One conversation, row after row. What all cheapest ways agree on is settled at once, so texts are held only
    while their edits are open; a row that must go is never held."""

    def __init__(self, emit: Callable[[int, str, str, str], None]):
        self.emit, self.chart, self.digest = emit, None, hashlib.sha256()
        self.open: list[tuple[str, str] | None] = []
        self.letters: list[str] = []
        self.faults: list[str] = []
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last = None
        self.place, self.expected, self.at = 0, "u", 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        letter, c = role[:1], self.counts
        if fault:
            c[{"b": "blank", "d": "duplicate", "t": "truncated"}[fault]] += 1
        if self.last is not None and (self.last, letter) not in LEGAL:
            c["illegal"] += 1
        if turn is not None:
            c["turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = letter
        self.letters.append(letter or "\0")
        self.faults.append(fault or " ")
        self.open.append(None if fault in ("b", "d") else (role, text))
        if len(self.letters) > AT_ONCE:
            self._read()
            self._settle(self.chart.decided())

    def _read(self) -> None:
        self.chart = self.chart or Chart(ROLES)
        for letter, fault in zip(self.letters, self.faults):
            self.chart.read(_row(letter, fault.strip()))
        self.letters, self.faults = [], []

    def _settle(self, edits: str) -> None:
        self.audit.append(edits)
        at = 0
        for edit in edits:
            role, text = "", ""
            if edit != "I":
                row = self.open[at]
                at += 1
                if edit == "D":
                    continue
                role, text = row
            if edit != "K":
                role = NAMES[self.expected]
            self.expected = "a" if role[:1] == "u" else "u"
            self.digest.update((f"\n{role}:{text}" if self.place else f"{role}:{text}").encode())
            self.emit(self.place, role, text, edit)
            self.place += 1
        del self.open[:at]

    def close(self) -> dict:
        if self.chart is None:
            cost, edits = _parsed("".join(self.letters), "".join(self.faults))
        else:
            self._read()
            cost, edits = self.chart.result()
        self._settle(edits)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"gaps": gaps, **{k: self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _stream(batches: Iterator[pa.RecordBatch], emit: Callable[[object, int, str, str, str], None], done: Callable[[object, dict], None]) -> Iterator[None]:
    """Conversations that are sorted one after the other; stops after every batch for what is to be sent off."""
    key, now = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(lo, BATCH_ROWS)
            for conv, turn, role, text, present, fault in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or conv != key:
                    if now is not None:
                        done(key, now.close())
                    key = conv
                    now = Repair(lambda place, r, x, e, k=conv: emit(k, place, r, x, e))
                if present:
                    now.add(turn, role, text, fault)
            yield
    if now is not None:
        done(key, now.close())
    yield


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "place long, role string, text string, edit string"


def _output(rows: DataFrame, fields: str, of_messages: bool) -> DataFrame:
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out = to_arrow_schema(schema), []
        emit = (lambda *row: out.append(row)) if of_messages else (lambda *row: None)
        done = (lambda conv, report: None) if of_messages else (lambda conv, report: out.append((conv, *report.values())))
        for _ in _stream(batches, emit, done):
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
                out.clear()
                yield pa.record_batch(columns, schema=arrow)

    return _marked(rows).mapInArrow(run, schema)


def repair_reports(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the rows (conv, turn, role,
    text, present), one a conversation; ``audit`` has the initial of every edit in order (Keep, Rerole, Delete, Insert).

    Rows stand in the order of their turns, nulls first, then of role and text. The first fault of a row counts: no
    word, role and text seen before, last character no sentence end. Blank and repeated rows have to go. Edits are
    those of an error-correcting Earley parse (``earley.ROLES``): the cheapest, of equally cheap ones the audit that
    comes first in ASCII. Null roles and texts are one space. Rows that are not ``present`` only name their
    conversation; one without other rows has zeros, an empty audit and the hash of an empty string. A null conversation
    is one like any other; no rows give no reports. A conversation is read by one task as a sorted stream, as its hash
    needs it, and is never held whole but for its audit and the rows whose edits are not settled yet.
    """
    return _output(rows, REPORT, False)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit) of every message of the repaired conversations, by the rules of
    ``repair_reports``; what was put in has an empty text."""
    return _output(rows, MESSAGES, True)


