"""Vectors of nodes from their text, by hashed character n-grams.

No model is at hand; ``Embedder`` is what another encoder has to offer. Blank
text has the zero vector, which is similar to nothing.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 384


class Embedder(Protocol):
    """Encodes texts to unit vectors (or zeros)."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of character 3- to 5-grams of lower-case words, hashed to ``dim`` places, of unit length."""

    def __init__(self, dim: int = DIMENSION) -> None:
        self.dim = dim
        self._known: dict[str, np.ndarray] = {}

    def _word(self, word: str) -> np.ndarray:
        """Places and signs of a word's n-grams as one number each: place times two, plus one if it counts up."""
        if word not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            padded = f"<{word}>"
            found = [zlib.crc32(padded[i : i + n].encode()) for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
            h = np.array(found, dtype=np.int64)
            self._known[word] = ((h >> 1) % self.dim) * 2 + (h & 1)
        return self._known[word]

    def encode(self, texts: list[str]) -> np.ndarray:
        """One count over all n-grams of all texts; words are hashed once."""
        parts = [[self._word(w) for w in text.lower().replace("_", " ").split()] for text in texts]
        rows = np.repeat(np.arange(len(texts)), [sum(map(len, p)) for p in parts])
        grams = np.concatenate([g for p in parts for g in p]) if len(rows) else np.zeros(0, dtype=np.int64)
        counts = np.bincount(rows * self.dim + grams // 2, weights=(grams % 2) * 2.0 - 1.0, minlength=len(texts) * self.dim)
        out = counts.astype(np.float64).reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)


def _present(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def function_text(name: Column, signature: Column, docstring: Column) -> Column:
    """Name, signature and docstring on a line each; missing or empty ones are left out."""
    return F.concat_ws("\n", _present(name), _present(signature), _present(docstring))


def listed_text(name: Column, label: str, items: Column) -> Column:
    """Name and a labelled list (methods of a class, fields of a struct)."""
    return F.concat_ws("\n", _present(name), F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", "))))


def embed(df: DataFrame, id_col: str, text: Column, embedder: Embedder | None = None) -> DataFrame:
    """(vec_id, embedding) of each row."""
    encoder = embedder or HashingEmbedder()

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode([t or "" for t in texts])))

    udf = F.pandas_udf(encode, T.ArrayType(T.FloatType()))
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), udf(text).alias("embedding"))
