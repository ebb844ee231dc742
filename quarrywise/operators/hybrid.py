"""Vector and hybrid chunk search: exact cosine neighbours, keyword ranks, reciprocal rank fusion."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
#: Rows from which vectors are dealt into cells, the sample their centres are fitted on, and cells that a search looks at.
ANN_ROWS = 4096
SAMPLE = 20_000
PROBES = 8


class Embedder(Protocol):
    """What turns texts into vectors of one dimension."""

    model_name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder without a model: signed feature hashing of words, unit length."""

    def __init__(self, dimension: int = 64):
        self.model_name, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def embedded(chunks: DataFrame, embedder: Embedder, column: str = "text", batch: int = 32) -> DataFrame:
    """chunks with a column ``vector``; the embedder is sent to the workers once, texts in batches."""
    shared = chunks.sparkSession.sparkContext.broadcast(embedder)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in shared.value.embed(rows[i : i + batch])])

    return chunks.withColumn("vector", F.pandas_udf(run, "array<float>")(column))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """(rank, key, similarity) of the k nearest by cosine; an exact scan with a bounded top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select(key, F.round(cosine(F.col(column), q), 4).alias("similarity")).filter("similarity IS NOT NULL").orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


def train_cells(vectors: DataFrame, key: str, column: str, sample: int = SAMPLE, rounds: int = 10) -> list[list[float]]:
    """Centres of about the root of the number of rows, 1,024 at most, by spherical k-means on a sample taken by the hash of key."""
    n = vectors.count()
    rows = vectors.filter(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(column).collect()
    x = np.array([r[0] for r in rows], float)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    if not len(x):
        return []
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.linspace(0, len(x) - 1, min(len(x), 1024, max(1, round(n**0.5)))).astype(int)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres.tolist()


def with_cells(vectors: DataFrame, column: str, centres: list[list[float]]) -> DataFrame:
    """vectors with a column ``cell``: the nearest centre; all of one cell without centres."""
    if not centres:
        return vectors.withColumn("cell", F.lit(0))
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centres))

    def nearest_cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([np.zeros(shared.value.shape[1]) if v is None else v for v in part], float)
            yield pd.Series((x @ shared.value.T).argmax(1) if len(x) else [], dtype="int32")

    return vectors.withColumn("cell", F.pandas_udf(nearest_cell, "int")(column))


def probed(vectors: DataFrame, centres: list[list[float]], query: list[float], probes: int = PROBES) -> DataFrame:
    """The vectors in the cells nearest to a query; all without centres."""
    if not centres or probes >= len(centres):
        return vectors
    near = np.argsort(-(np.array(centres) @ np.array(query)), kind="stable")[:probes]
    return vectors.filter(F.col("cell").isin([int(c) for c in near]))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """(rank, key, score): ranked lists joined by the sum of 1 / (60 + rank)."""
    both = keyword.select(key, F.col("rank").alias("a")).join(vector.select(key, F.col("rank").alias("b")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    scored = both.select(key, F.round(part("a") + part("b"), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
