"""Words of text without spaces: a dictionary as a prefix tree, and the best path through the graph of its words."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights are whole millionths of a natural logarithm, so that sums are exact and ties are ties.
SCALE = 1_000_000
MOST_WORDS = 1_000_000
_WORD = ""  # no character is this key
_RUN = re.compile(r"[A-Za-z0-9]+")


class Dictionary:
    """Words with weights. A word's weight is the logarithm of its share of all counts; a character that is no word of
    its own weighs like a word that was counted once, and with ``runs`` so does a run of ASCII letters and digits as a
    whole."""

    def __init__(self, counts: dict[str, int], runs: bool = True):
        self.runs = runs
        if any(re.search(r"\s", w) or not w for w in counts):
            raise ValueError("words are not empty and have no white space")
        self.total = max(1, sum(max(1, n) for n in counts.values()))
        self.unknown = self.weight(1)
        self.root: dict = {}
        for word, n in counts.items():
            self._add(word, self.weight(max(1, n)))

    def weight(self, n: float) -> int:
        return math.floor(SCALE * math.log(n / self.total))

    def _add(self, word: str, weight: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[_WORD] = weight

    def add_whole(self, word: str) -> None:
        """A word without a count: just heavy enough not to be cut by the words there are."""
        _, weight = self._best(word)[0]
        self._add(word, weight + 1)

    def ends(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, weight) of the words that begin at ``start``."""
        node, at = self.root, start
        while at < len(text) and (node := node.get(text[at])) is not None:
            at += 1
            if _WORD in node:
                yield at, node[_WORD]

    def _best(self, text: str) -> list[tuple[int, int]]:
        """From every place, where the first word ends and what the best way to the end weighs; of equally good ways
        the one with the longer first word."""
        runs = {m.start(): m.end() for m in _RUN.finditer(text)} if self.runs else {}
        best = [(0, 0)] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            steps = dict(self.ends(text, i))
            steps.setdefault(runs.get(i, i + 1), self.unknown)
            weight, end = max((w + best[j][1], j) for j, w in steps.items())
            best[i] = (end, weight)
        return best

    def words(self, text: str) -> list[str]:
        """All of a text's words in order, cut at white space and then by the best path; white space is left out."""
        out = []
        for part in text.split():
            best, at = self._best(part), 0
            while at < len(part):
                out.append(part[at : best[at][0]])
                at = best[at][0]
        return out


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """A dictionary of lines ``word [count [tag]]``. Words without a count are added last, each as one that is not cut.
    A dictionary is small by its nature; beyond a million words it is refused."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("n"))
    return of_counts(rows.groupBy("word").agg(F.max("n").alias("n")))


def of_counts(counts: DataFrame, runs: bool = True) -> Dictionary:
    """The dictionary of (word, n); n may be null."""
    rows = counts.select("word", "n").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError("a dictionary has a million words at most")
    found = Dictionary({r.word: r.n for r in rows if r.n is not None}, runs)
    for word in sorted(r.word for r in rows if r.n is None):
        found.add_whole(word)
    return found


def segmenter(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A function of text columns to arrays of words, for ``text.tokens(segment=…)``. The dictionary goes to every
    worker once a query; texts go there in Arrow batches. A null text has no words."""

    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else dictionary.words(t))

    return segment
