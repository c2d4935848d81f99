"""Batched vector retrieval equals single queries."""

import random

from pyspark.sql import functions as F

from tesserae.operators import batches, search


def test_batched_queries_equal_single_ones(spark, monkeypatch):
    monkeypatch.setattr(batches, "QUERIES", 4)
    monkeypatch.setattr(batches, "ROWS", 16)
    rng = random.Random(2)
    vector = lambda n: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(n)]
    rows = [(f"r{k}", vector(rng.choice((4, 4, 4, 3)))) for k in range(150)] + [("none", None), ("zero", [0.0] * 4), ("empty", [])]
    store = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).repartition(5)
    asked = [(str(k), vector(rng.choice((4, 4, 3)))) for k in range(9)] + [("z", [0.0] * 4), ("no", None)]
    found: dict = {}
    for r in batches.nearest(store, spark.createDataFrame(asked, "query_id string, vector array<double>"), 12).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, round(r.semantic, 6)))
    assert set(found) == {q for q, v in asked if v is not None}
    for q, v in asked:
        if v is not None:
            want = search.semantic_candidates(store, v, 1000, 12).collect()
            assert [(i, s) for _, i, s in sorted(found[q])] == [(r.id, round(r.semantic, 6)) for r in want]


def test_no_queries_and_no_rows(spark):
    store = spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    assert batches.nearest(store, asked.limit(0)).count() == 0 and batches.nearest(store.limit(0), asked).count() == 0
