"""Table functions for SQL: sentences of a text, and what a model's answer holds, as rows (``LATERAL``)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ravelin.functions import text

#: What an answer may hold: the list in it, and the fields of its rows.
KINDS = {"entities": ["name", "type", "description"], "relations": ["head", "relation", "tail", "description"]}


class Extracted:
    """``ravelin_extracted(answer, kind)``: a row for each element of the list ``kind`` (entities or relations, a
    constant) in a model's answer, whatever stands around its JSON. The columns follow from the kind. An answer that does
    not parse, or has no such list, gives no rows; a field that is missing is null."""

    @staticmethod
    def analyze(answer: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"the kind is one of {sorted(KINDS)}, as a constant")
        return AnalyzeResult(StructType([StructField(f, StringType()) for f in KINDS[kind.value]]))

    def eval(self, answer: str | None, kind: str) -> Iterator[tuple]:
        raw = answer or ""
        try:
            found = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
        except ValueError:
            return
        rows = found.get(kind) if isinstance(found, dict) else None
        for row in rows if isinstance(rows, list) else ():
            if isinstance(row, dict):
                yield tuple(None if row.get(f) is None else str(row[f]) for f in KINDS[kind])


def register(spark: SparkSession) -> None:
    """``ravelin_extracted(answer, kind)``, and ``ravelin_sentence_rows(text)``: (pos, sentence) of every sentence, which
    is SQL itself and stays in the engine."""
    text.register(spark)
    spark.udtf.register("ravelin_extracted", F.udtf(Extracted))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ravelin_sentence_rows(t STRING) RETURNS TABLE (pos INT, sentence STRING) RETURN SELECT pos, col FROM (SELECT ravelin_sentences(t) AS s) LATERAL VIEW posexplode(s) AS pos, col")
