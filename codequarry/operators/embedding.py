"""Embedding providers behind one table function; the default one needs no network."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 200
PROVIDERS: dict[str, Callable[[list[str], int], np.ndarray]] = {}


def provider(name: str):
    """Register ``f(texts, dimensions) -> matrix`` under a name."""

    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("hashing")
def hashing(texts: list[str], dim: int) -> np.ndarray:
    """Signed hashed words, normalised: the same text has the same vector everywhere."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text_col: str, name: str = "hashing", dim: int = 64) -> DataFrame:
    """``df`` with a ``vector`` column; texts go to the provider in batches of 200."""
    call = PROVIDERS[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = [call(s.iloc[i : i + BATCH].tolist(), dim) for i in range(0, len(s), BATCH)]
            yield pd.Series([v for m in rows for v in m], index=s.index, dtype=object)

    return df.withColumn("vector", run(F.col(text_col)))


def embed_missing(df: DataFrame, text_col: str, name: str = "hashing", dim: int = 64) -> DataFrame:
    """Fill only null vectors; rows that have one never reach the provider."""
    have, lack = df.where("vector is not null"), df.where("vector is null").drop("vector")
    return have.unionByName(embed(lack, text_col, name, dim))
