"""Embedding providers, and the backfill that uses them in batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_ROWS = 8


class Provider(Protocol):
    """What an embedding source offers; it must be picklable, since tasks use it."""

    enabled: bool

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Disabled:
    enabled = False

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise RuntimeError("embeddings are disabled")


class Hashed:
    """Deterministic unit vectors of word hashes, for tests and offline work."""

    enabled = True

    def __init__(self, size: int = 16) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def valid(vector: object) -> bool:
    return isinstance(vector, list) and bool(vector) and all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector)


def embed_safely(provider: Provider, texts: list[str]) -> list[list[float] | None]:
    """A batch; where it fails or its count is wrong, each text alone; None where that fails too."""
    try:
        found = provider.embed(texts)
        if len(found) == len(texts) and all(map(valid, found)):
            return found
    except Exception:  # noqa: BLE001  a provider may raise anything
        pass
    out: list[list[float] | None] = []
    for t in texts:
        try:
            (one,) = provider.embed([t])
            out.append(one if valid(one) else None)
        except Exception:  # noqa: BLE001
            out.append(None)
    return out


def input_of(content: Column, max_bytes: int) -> Column:
    """The first max_bytes bytes of a text, without a split character at the end, trimmed."""
    return F.trim(F.make_valid_utf8(F.substring(F.encode(content, "UTF-8"), 1, max_bytes).cast("string")))


def backfill(rows: DataFrame, provider: Provider, max_bytes: int = 8000) -> DataFrame:
    """(id, embedding) of rows(id, content); null where the provider failed."""
    if not provider.enabled:
        raise RuntimeError("embeddings are disabled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = list(b["_text"]), []
            for k in range(0, len(texts), BATCH_ROWS):
                out += embed_safely(provider, texts[k : k + BATCH_ROWS])
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    return rows.select("id", input_of(F.col("content"), max_bytes).alias("_text")).mapInPandas(run, "id string, embedding array<double>")


def filled(store: DataFrame, vectors: DataFrame) -> DataFrame:
    """The store with missing embeddings taken from vectors(id, embedding)."""
    new = vectors.select("id", F.col("embedding").alias("_v"))
    return store.join(new, "id", "left").withColumn("embedding", F.coalesce("embedding", "_v")).select(store.columns)
