"""Embedders: a registry of providers, and two that need no model.

``precomputed`` reads vectors from a table; ``hashing`` is signed feature hashing of words (Weinberger et al., 2009).
Blank texts are set aside row by row instead of failing a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import split_words, strip


class Embedder(Protocol):
    provider: str
    model: str
    dimension: int

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``embedding``."""

    def is_available(self) -> bool:
        """Whether texts can be embedded now."""

    def close(self) -> None:
        """Give up what the embedder holds."""


def model_info(embedder: Embedder) -> dict:
    """Provider, model and dimension of an embedder, and whether it can be used."""
    return {"provider": embedder.provider, "model": embedder.model, "dimension": embedder.dimension, "available": embedder.is_available()}


@lru_cache(1 << 18)
def _hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


class HashingEmbedder:
    """Signed counts of hashed words, at length one: a word's slot and sign come from the first 8 hex digits of its MD5 sum."""

    provider = "hashing"

    def __init__(self, dimension: int = 48, normalize: bool = True):
        if dimension < 1:
            raise ValueError("dimension must be positive")
        self.dimension, self.normalize, self.model = dimension, normalize, f"hashing-{dimension}"

    def vector(self, text: Column) -> Column:
        """The embedding of a text column: all zero for texts without words."""
        d, normalize = self.dimension, self.normalize

        @F.pandas_udf("array<double>")
        def slots(words: pd.Series) -> pd.Series:
            out = []
            for ws in words:
                v = np.zeros(d)
                for w in [] if ws is None else ws:
                    h = _hash(w)
                    v[h % d] += 1.0 if (h // d) % 2 == 0 else -1.0
                n = np.linalg.norm(v)
                out.append(v / n if normalize and n else v)
            return pd.Series(out, dtype=object)

        return slots(split_words(F.lower(text)))

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("embedding", self.vector(F.col(text)).cast("array<float>"))

    def is_available(self) -> bool:
        return True

    def close(self) -> None:
        """Nothing is held."""


class PrecomputedEmbedder:
    """Vectors of a table, joined by a key; rows without one get null."""

    provider = "precomputed"

    def __init__(self, vectors: DataFrame, key: str, model: str, dimension: int, column: str = "embedding"):
        self.vectors, self.key, self.model, self.dimension, self.column = vectors, key, model, dimension, column

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        vectors = self.vectors.select(self.key, F.col(self.column).alias("embedding")).dropDuplicates([self.key])
        return df.join(vectors, self.key, "left")

    def is_available(self) -> bool:
        return not self.vectors.isEmpty()

    def close(self) -> None:
        self.vectors.unpersist()


_PROVIDERS: dict[str, Callable[..., Embedder]] = {}


def register_provider(name: str, factory: Callable[..., Embedder]) -> None:
    """Make a provider available under a name; a second registration replaces the first."""
    _PROVIDERS[name] = factory


def create_embedder(name: str, **options) -> Embedder:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}; available: {', '.join(available_providers())}")
    return _PROVIDERS[name](**options)


def available_providers() -> list[str]:
    return sorted(_PROVIDERS)


register_provider("hashing", HashingEmbedder)
register_provider("precomputed", PrecomputedEmbedder)


def quarantine_blank(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows that can be embedded, rows with null or blank text)."""
    blank = F.col(text).isNull() | (strip(F.col(text)) == "")
    return df.where(~blank), df.where(blank)
