"""Hooks for batch models: any function from texts to scores or vectors runs as an iterator Arrow UDF."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the built-in lexicon scorer.
POSITIVE = ("good", "gain", "growth", "bullish", "up", "win", "strong")
NEGATIVE = ("bad", "loss", "drop", "bearish", "down", "fail", "weak")


def text_scorer(load: Callable[[], Callable[[Sequence[str]], Sequence[float]]]):
    """UDF from text to score. ``load`` runs once in each task and gives a function of a batch; a batch that it fails on is
    scored text by text, and those it fails on alone are 0, nulls too."""

    def one(score: Callable[[Sequence[str]], Sequence[float]], text: str) -> float:
        try:
            return float(score([text])[0])
        except (ValueError, RuntimeError):
            return 0.0

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for texts in parts:
            batch = texts.fillna("").tolist()
            try:
                found = np.asarray(score(batch), dtype=float)
            except (ValueError, RuntimeError):
                found = np.array([one(score, t) for t in batch])
            yield pd.Series(found, index=texts.index).where(texts.notna(), 0.0)

    return run


def text_embedder(load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]):
    """UDF from text to array<float>; null texts are embedded as empty ones."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in parts:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in embed(texts.fillna("").tolist())], index=texts.index)

    return run


def signed_label(label: Column, score: Column) -> Column:
    """A classifier's label and confidence as a number from -1 to 1."""
    return F.when(F.lower(label) == "positive", score).when(F.lower(label) == "negative", -score).otherwise(0.0)


def lexicon(positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE):
    """(positive - negative) / (positive + negative) words of each text."""

    def load():
        good, bad = set(positive), set(negative)

        def score(texts: Sequence[str]) -> list[float]:
            out = []
            for t in texts:
                words = t.lower().split()
                p, n = sum(w in good for w in words), sum(w in bad for w in words)
                out.append((p - n) / (p + n) if p + n else 0.0)
            return out

        return score

    return load


def hashed_counts(dimensions: int = 64):
    """Unit vectors of word counts hashed into ``dimensions``."""

    def load():
        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    out[i, h % dimensions] += 1 if h >> 31 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return embed

    return load
