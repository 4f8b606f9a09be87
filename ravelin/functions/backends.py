"""Models behind columns. A backend is made once per task and sees Arrow batches; deterministic ones serve tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """What the engine asks of models; a method that is not there is not asked."""

    def chat(self, prompt: str) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class Deterministic:
    """Hash embeddings, word-overlap reranking and an echo: enough to run and check everything around a model."""

    def __init__(self, size: int = 64):
        self.size = size

    def chat(self, prompt: str) -> str:
        return prompt.strip().splitlines()[-1] if prompt.strip() else ""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


class Rotating:
    """Models in turn: each attempt goes to the next one, a refusal ends the attempts, a local fallback that once
    answered is used from then on; if all fail the answer is empty."""

    def __init__(self, models: list[Callable[[str], str]], fallback: Callable[[str], str] | None = None, rounds: int = 2, refused: type[Exception] = PermissionError):
        self.models, self.fallback, self.rounds, self.refused, self.local = models, fallback, rounds, refused, False

    def chat(self, prompt: str) -> str:
        if not self.local:
            for attempt in range(self.rounds * len(self.models)):
                try:
                    if found := self.models[attempt % len(self.models)](prompt):
                        return found
                except self.refused:
                    break
                except Exception:
                    continue
        if self.fallback is not None:
            try:
                found = self.fallback(prompt)
                self.local = self.local or bool(found)
                return found
            except Exception:
                return ""
        return ""


def chat(prompt: Column, backend: Callable[[], Backend]) -> Column:
    """A model's answer for each prompt; null where it fails or is blank."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = backend()
        for batch in batches:
            out = []
            for p in batch:
                try:
                    found = model.chat(p) if p is not None else None
                except Exception:
                    found = None
                out.append(found if found and found.strip() else None)
            yield pd.Series(out, dtype=object)

    return ask(prompt)


def embed(text: Column, backend: Callable[[], Backend], batch_size: int = 32) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = backend()
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([list(v) for lo in range(0, len(texts), batch_size) for v in model.embed(texts[lo : lo + batch_size])], dtype=object)

    return run(text)


def rerank_score(query: Column, text: Column, backend: Callable[[], Backend], most_chars: int = 512) -> Column:
    """A model's score of each text for its query: one call for all texts of a query in an Arrow batch."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = backend()
        for q, t in batches:
            out = pd.Series(index=t.index, dtype=float)
            for one, texts in t.fillna("").groupby(q.fillna("")):
                out[texts.index] = model.rerank(one, texts.tolist())
            yield out

    return run(query, F.substring(text, 1, most_chars))


def rewrite(query: Column, history: Column | None, backend: Callable[[], Backend]) -> Column:
    """The query as a model rewrites it before retrieval; trimmed but otherwise itself where the model fails."""
    prompt = query if history is None else F.concat_ws("\n", history, query)
    return F.coalesce(F.nullif(F.trim(chat(prompt, backend)), F.lit("")), F.trim(query))


def extract_wave(chunks: DataFrame, backend: Callable[[], Backend]) -> DataFrame:
    """(chunk_id, raw): what a model extracts from each chunk, null where it fails."""
    return chunks.select("chunk_id", chat(F.substring("text", 1, 800), backend).alias("raw"))
