"""What keeps the write path, the index and chunks in proportion to their input."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from tesserae.operators import chunks, facts, ingest, postings

AT = datetime(2024, 1, 1)
BATCH = "seq long, at timestamp, idempotency_key string, scope_type string, scope_id string, content string, tags array<string>, importance double, ttl_days int, key string, captured boolean, source_agent string, metadata map<string,string>"
STORE = "id string, scope_type string, scope_id string, content string, content_hash string, canonical_key string, tags array<string>, importance double, captured boolean, source_agent string, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp, seq bigint"


def test_many_writes_of_one_content(spark, monkeypatch):
    """Their contents go through no window, no frame is read again for each row, and blocks of them merge in order."""
    monkeypatch.setattr(ingest, "BLOCK", 1)
    rows = [(k, AT, None, "global", None, "one fact", [f"t{k}", "all"], k / 100, None, None, True, f"a{k}", {"last": str(k), f"m{k % 3}": "x"}) for k in range(80)]
    batch = spark.createDataFrame(rows, BATCH).repartition(3)
    store, ready, columns = ingest._aligned(spark.createDataFrame([], STORE), ingest.normalized(batch))
    writes, merged = ingest.versions(store, ready, columns)
    assert "content" not in writes.columns and "content" not in merged.columns
    assert "unboundedfollowing" not in writes._jdf.queryExecution().analyzed().toString().lower()
    (row,) = ingest.upsert(spark.createDataFrame([], STORE), batch).collect()
    assert row.content == "one fact" and row.tags == ["t0", "all", *(f"t{k}" for k in range(1, 63))]
    assert (row.importance, row.source_agent, row.seq, row.metadata) == (0.79, "a79", 79, {"last": "79", "m0": "x", "m1": "x", "m2": "x"})


def test_postings_are_grouped_without_a_shuffle(spark):
    texts = [("a", "b c B. É b"), ("b", None), ("c", ""), ("d", "c " * 600)]
    rows = spark.createDataFrame([(k, "project", "p", t) for k, t in texts], "id string, scope_type string, scope_id string, content string")
    packed = postings.packed(rows)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    found = postings.unpacked(packed)
    got = sorted((r.id, r.term, r.n, r.positions) for r in found.collect())
    assert got == [("a", "b", 5, [0, 2, 4]), ("a", "c", 5, [1]), ("a", "e", 5, [3]), ("d", "c", 600, list(range(600)))]
    assert found.where(F.col("_bucket") != postings.bucket(F.col("term"))).count() == 0


def test_chunks_without_contents(spark):
    rows = spark.createDataFrame([(k, "ab🙂cdé " * k) for k in range(40)], "doc_id long, text string")
    bare, whole = (chunks.split(rows, "doc_id", "text", 20, 5, contents=c) for c in (False, True))
    assert bare.columns == ["parent_id", "chunk_index", "start_byte", "end_byte"]
    assert sorted(map(tuple, bare.collect())) == sorted(r[:4] for r in map(tuple, whole.collect())) == sorted((k, *w[:3]) for k in range(40) for w in chunks.windows("ab🙂cdé " * k, 20, 5))


def test_facts_of_a_long_conversation(spark):
    """Each fact counts once, in time that does not grow with the square of their number."""
    parts = [f"Line {k % 30_000} of a very long Conversation" for k in range(40_000)] + ["LINE 7 OF A VERY LONG CONVERSATION"]
    rows = spark.createDataFrame([(1, "\n".join(parts)), (2, "The same sentence here.\nthe same sentence here."), (3, None)], "seq long, text string")
    begun = time.monotonic()
    found = facts.candidates(rows).select("seq", "pos", "fact").orderBy("seq", "pos").collect()
    assert time.monotonic() - begun < 90
    assert [(r["pos"], r["fact"]) for r in found if r["seq"] == 1] == list(enumerate(parts[:30_000]))
    assert [(r["pos"], r["fact"]) for r in found if r["seq"] != 1] == [(0, "The same sentence here.")]
