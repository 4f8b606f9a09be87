"""Prompts of the model-backed steps, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import text as X

ANALYSE = """Read the question and answer in JSON with the fields query_mode (naive: one fact about one thing; local: things and
what they are linked to; global: themes over many sources; hybrid: several of these), low_level_keywords (names),
high_level_keywords (topics) and reason."""
JUDGE = """Does the numbered evidence answer the question? Answer in JSON with the fields sufficient (true or false), missing
(what the evidence lacks, as a list) and reason."""
REWRITE = "Write one search query that finds what is missing for the question. Answer with the query alone."
ANSWER = "Answer the question from the numbered sources alone, naming the numbers you use. Say so if they do not answer it."
EXTRACT = """List the entities and relations of the text in JSON: entities with name, type and description; relations with head,
relation, tail and description."""


def _asked(task: str, **parts: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(task), *(F.concat(F.lit(f"{name}:\n"), part) for name, part in parts.items()))


def analyse(question: Column) -> Column:
    return _asked(ANALYSE, Question=question)


def judge(question: Column, evidence: Column) -> Column:
    return _asked(JUDGE, Question=question, Evidence=evidence)


def rewrite(question: Column, current: Column, missing: Column) -> Column:
    return _asked(REWRITE, Question=question, Tried=current, Missing=X.bullet_list(missing))


def answer(question: Column, context: Column) -> Column:
    return _asked(ANSWER, Sources=context, Question=question)


def extract(text: Column) -> Column:
    return _asked(EXTRACT, Text=F.substring(text, 1, 800))
