"""Embedders: text to unit vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 768


class Embedder(Protocol):
    name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words as they are and lower-cased character trigrams, hashed into buckets (FNV-1a), length 1."""

    name = "hash"

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._known: dict[bytes, int] = {}

    def _bucket(self, key: bytes) -> int:
        if key not in self._known:
            h = 0xCBF29CE484222325
            for byte in key:
                h = (h ^ byte) * 0x100000001B3 % 2**64
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[key] = h % self.dimensions
        return self._known[key]

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            lower = text.lower()
            keys = [w.encode() for w in text.split()] + [lower[k : k + 3].encode()[:12] for k in range(len(lower) - 2)]
            np.add.at(row, [self._bucket(k) for k in keys], 1.0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embedded(text: Column, embedder: Embedder) -> Column:
    """A column of vectors, a batch at a time; the embedder is loaded once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(embedder.embed(b.fillna("").tolist())))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
