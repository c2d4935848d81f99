"""Vector retrieval for a table of queries at once: each task keeps its best rows of each query, and one window merges them.

No query's vector is part of a plan: blocks of QUERIES queries go to the tasks as one matrix, so the store is scanned once a block, and a
task hands on at most kept rows for each query, however many it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.search import ROW_KEPT

#: Queries of a block, and rows that are scored at once.
QUERIES, ROWS = 1024, 2048


def _matrices(vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size: which of the vectors have it, and these with length one (or zero)."""
    out = {}
    for n in {len(v) for v in vectors}:
        at = np.array([k for k, v in enumerate(vectors) if len(v) == n])
        x = np.array([vectors[k] for k in at], np.float64).reshape(len(at), n)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out[n] = at, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return out


def _scores(queries: dict, n_queries: int, vectors: list[list[float]]) -> np.ndarray:
    """Similarities as scoring.cosine gives them: 0 where sizes differ or a vector is zero, else (cosine + 1) / 2."""
    out = np.zeros((n_queries, len(vectors)))
    for n, (at, rows) in _matrices(vectors).items():
        if n and n in queries:
            which, q = queries[n]
            known = np.any(q, axis=1)[:, None] & np.any(rows, axis=1)[None, :]
            out[np.ix_(which, at)] = np.where(known, np.clip((q @ rows.T + 1) / 2, 0, 1), 0)
    return out


def _block(rows: DataFrame, ids: list[str], vectors: list[list[float]], kept: int) -> DataFrame:
    queries = _matrices(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id: list = [np.empty(0, object) for _ in ids]
        best: list = [np.empty(0) for _ in ids]
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                names, found = np.array(part.column(0).to_pylist(), object), _scores(queries, len(ids), part.column(1).to_pylist())
                for i, s in enumerate(found):
                    if len(s) > kept:  # ties of the last place stay
                        take = s >= np.partition(s, len(s) - kept)[len(s) - kept] - 2e-9
                        s, new = s[take], names[take]
                    else:
                        new = names
                    every, name = np.concatenate([best[i], s]), np.concatenate([best_id[i], new])
                    order = sorted(range(len(every)), key=lambda j: (-round(every[j], 9), name[j]))[:kept]  # noqa: B023
                    best[i], best_id[i] = every[order], name[order]
        for q, name, s in zip(ids, best_id, best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), pa.string()), pa.array(list(name), pa.string()), pa.array(s, pa.float64())], ["query_id", "id", "semantic"])

    return rows.select("id", F.col("embedding").cast("array<double>")).where("embedding is not null").mapInArrow(run, "query_id string, id string, semantic double")


def nearest(rows: DataFrame, queries: DataFrame, kept: int = ROW_KEPT) -> DataFrame:
    """(query_id, id, semantic, rank): the kept nearest of rows(id, embedding) for each of queries(query_id, vector).

    As search.semantic_candidates for each query alone over all rows. Queries without a vector have no rows.
    """
    found = rows.sparkSession.createDataFrame([], "query_id string, id string, semantic double")
    ids: list[str] = []
    vectors: list[list[float]] = []
    asked = queries.where("vector is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    for r in asked.toLocalIterator():
        ids.append(r.query_id)
        vectors.append(list(r.vector))
        if len(ids) == QUERIES:
            found, ids, vectors = found.unionByName(_block(rows, ids, vectors, kept)), [], []
    if ids:
        found = found.unionByName(_block(rows, ids, vectors, kept))
    order = Window.partitionBy("query_id").orderBy(F.round("semantic", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
