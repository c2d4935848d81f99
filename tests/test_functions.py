import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scoring as S
from tesserae.functions import text as X
from tesserae.functions.redact import redacted
from tesserae.operators import chunks
from tesserae.plans import scope as P


def one(spark, column, **values):
    """The value of an expression over one row."""
    row = spark.range(1).select(*(v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, key", [
    ("  Favorite Zebra's Color! ", "favorite_zebras_color"), ("__a--b__", "a_b"), ("’’", None), ("", None), ("É", None),
])
def test_canonical_key(spark, given, key):
    assert one(spark, X.canonical_key(F.col("c")), c=given) == key


@pytest.mark.parametrize("content, key", [
    ("Favorite zebra color: black and white", "favorite_zebra_color"), ("Canonical user preference: favorite notebook cover color is green", "favorite_notebook_cover_color"),
    ("My favorite color: red", None), ("favorite : x", None),
])
def test_inferred_key(spark, content, key):
    assert one(spark, X.inferred_key(F.col("c")), c=content) == key


def test_written_key_prefers_metadata_then_idempotency_key(spark):
    tags = F.array(F.lit("user-preference"))
    key = lambda stored, idem: one(spark, X.written_key(F.lit("Favorite a: b"), tags, F.lit(stored).cast("string"), F.lit(idem).cast("string")), c="")
    assert key("My Key", "favorite-x") == "my_key"
    assert key(None, "favorite-x") == "favorite_x"
    assert key(None, "other") == "favorite_a"


def test_redaction(spark):
    secret = "sk-" + "a1" * 12
    text = f"key {secret}\nAuthorization: bearer abcdefghij0123456789XY\nid AKIA{'A1' * 8}"
    r = one(spark, redacted(F.col("c")), c=text)
    assert r["redacted"] and set(r["findings"]) == {"openai_key", "bearer_token", "aws_access_key"}
    assert r["text"] == "key [REDACTED_OPENAI_KEY]\nAuthorization: bearer [REDACTED_BEARER_TOKEN]\nid [REDACTED_AWS_ACCESS_KEY]"
    mixed = "aB3dE5gH7jK9mN1pQ3sT5vW7"
    assert one(spark, redacted(F.col("c")), c=f"x {mixed} {mixed}")["text"] == "x [REDACTED_SECRET] [REDACTED_SECRET]"
    clean = one(spark, redacted(F.col("c")), c="hex 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e")
    assert not clean["redacted"] and clean["findings"] == []


def test_fact_parts_and_score(spark):
    text = "Short. We must remember the deadline of this project: 5 days.\n  we MUST remember the deadline of this project: 5 days. "
    parts = one(spark, X.fact_parts(F.col("c")), c=text)
    assert parts == ["We must remember the deadline of this project: 5 days.", "we MUST remember the deadline of this project: 5 days."]
    n = len(parts[0])
    assert one(spark, X.fact_score(F.col("c")), c=parts[0]) == pytest.approx(min(n / 120, 1.25) + 1 + 0.25 + 0.15)
    assert one(spark, X.fact_score(F.col("c")), c="abcdefghijklmnopqrstu") == pytest.approx(21 / 120 - 0.3)


def test_terms_tokens_and_snippets(spark):
    assert X.query_terms("Foo_Bar café a x1 foo_bar") == [["foo", "bar"], ["caf"], ["x1"]]
    assert one(spark, X.tokens(F.col("c")), c="Café foo_bar, ÜBER-x 7") == ["cafe", "foo", "bar", "uber", "x", "7"]
    assert one(spark, X.truncated(F.col("c"), 5), c="abcd efgh") == "abcd\n… [truncated 4 chars]"
    assert one(spark, X.snippet(F.col("c"), 6), c=" a \n b c d e f") == "a b c…"
    assert one(spark, X.clean_tags(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b"))), c="") == ["a", "b"]
    assert one(spark, X.token_estimate(F.col("c")), c="abcde") == 22


def test_query_intents():
    assert X.is_preference_query("what do I prefer") and not X.is_preference_query("preferences of deer".replace("preferences", "deer"))
    assert X.is_temporal_query("what was it before") and not X.is_temporal_query("whatwas")


def test_scores(spark):
    now = datetime(2024, 3, 1)
    half = 30 * math.log(2)
    updated = F.lit(now - timedelta(days=half)).cast("timestamp")
    assert one(spark, S.recency(updated, now), c="") == pytest.approx(0.5, abs=1e-6)
    lit = lambda *xs: (F.lit(x) for x in xs)
    assert one(spark, S.combined(*lit(0.8, 0.6, 0.7, 0.5, "project"), True), c="") == pytest.approx(0.755)
    assert one(spark, S.lexical(F.lit(0.0)), c="") == 1 and one(spark, S.lexical(F.lit(5.0)), c="") == pytest.approx(1 / 6)
    vec = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, S.cosine(vec(1, 0), vec(0, 1)), c="") == 0.5
    assert one(spark, S.cosine(vec(1, 0), vec(1, 0, 0)), c="") == 0 and one(spark, S.cosine(vec(0, 0), vec(1, 0)), c="") == 0
    assert one(spark, S.importance(F.lit(float("nan"))), c="") == 0.5 and one(spark, S.importance(F.lit(7.0)), c="") == 1


def test_scopes(tmp_path):
    assert P.visible([]) == []
    assert P.visible(everything=True) == [P.Scope("global"), P.Scope("project", "*"), P.Scope("session", "*")]
    assert P.visible(project_path="/a/../b", session_id=" s ") == [P.Scope("global"), P.Scope("project", P.project_id("/b")), P.Scope("session", "s")]
    assert P.normalized(P.Scope("project", "AB" * 32)).id == "ab" * 32
    assert P.normalized(P.Scope("project", "x"), "/p").id == P.project_id("/p")
    with pytest.raises(ValueError):
        P.normalized(P.Scope("session", "  "))
    with pytest.raises(ValueError):
        P.Scope("team")


def test_scope_filter(spark):
    rows = spark.createDataFrame([("global", None), ("project", "a"), ("project", "b"), ("session", "s")], "scope_type string, scope_id string")
    count = lambda *scopes: rows.where(P.in_scope(scopes)).count()
    assert count() == 0 and count(P.Scope("global")) == 1 and count(P.Scope("project", "*")) == 2 and count(P.Scope("project", "a"), P.Scope("session", "s")) == 2


def test_chunk_windows():
    assert [c for *_, c in chunks.windows("abcdefghijklmnopqrstuvwxyz", 10, 3)] == ["abcdefghij", "hijklmnopq", "opqrstuvwx", "vwxyz"]
    found = list(chunks.windows("ab🙂cdéfg🙂hi", 7, 2))
    assert found[0][3] == "ab🙂c" and all(b - a <= 7 for _, a, b, _ in found) and "�" not in "".join(c for *_, c in found)
    assert list(chunks.windows("")) == []
    for bad in ((5, 5), (0, 0)):
        with pytest.raises(ValueError):
            list(chunks.windows("abc", *bad))
    with pytest.raises(ValueError):
        list(chunks.windows("🙂", 3, 0))


def test_chunks_of_a_table(spark):
    text = "é" * 3000
    rows = spark.createDataFrame([("a", text), ("b", "short"), ("c", None)], "id string, content string")
    found = chunks.split(rows, "id", "content", 1001, 100, 1000).orderBy("chunk_index").collect()
    assert [(r["start_byte"], r["end_byte"], r["content"]) for r in found] == [(a, b, c) for _, a, b, c in chunks.windows(text, 1001, 100)]
    assert {r["parent_id"] for r in found} == {"a"}
