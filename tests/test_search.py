from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators import canonical, lexical, search
from tesserae.plans.scope import Scope, visible

NOW = datetime(2024, 3, 1)
SCHEMA = "id string, seq long, scope_type string, scope_id string, content string, tags array<string>, importance double, captured boolean, canonical_key string, content_hash string, embedding array<double>, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp"


def row(id, content, scope=("global", None), tags=(), importance=0.5, captured=False, key=None, days=0, embedding=None, expires=None, deleted=None):
    at = NOW - timedelta(days=days)
    return (id, int.from_bytes(id.encode(), "big") % 1000, *scope, content, list(tags), importance, captured, key, content, embedding, at, at, expires, deleted)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_scopes_order_results(spark):
    phrase = "shared phrase alpha"
    rows = table(spark, row("global", phrase), row("project", phrase, ("project", "p"), importance=0.7), row("session", phrase, ("session", "s"), importance=0.0),
                 row("other-project", phrase, ("project", "q"), importance=1.0), row("other-session", phrase, ("session", "t"), importance=0.0))
    run = lambda scopes: ids(search.search(rows, "shared alpha", scopes, NOW))
    assert run(visible()) == ["global"]
    assert run([Scope("global"), Scope("project", "p")]) == ["project", "global"]
    assert set(run(visible(everything=True))) == {"global", "project", "session", "other-project", "other-session"}
    assert run([]) == []


def test_noise_is_demoted_and_backfills(spark):
    noisy = [row(f"n{k}", "Assistant: topic beta", tags=["import", "chatgpt-export", "transcript"], importance=0.8, captured=True, embedding=[1.0, 0.0]) for k in range(4)]
    rows = table(spark, row("clean", "a topic beta", embedding=[1.0, 0.0]), *noisy)
    assert ids(search.search(rows, "beta", visible(), NOW))[0] == "clean"
    semantic = search.search(rows, "zzz", visible(), NOW, vector=[1.0, 0.0])
    assert ids(semantic)[0] == "clean" and semantic.count() == 5


def test_expired_deleted_and_empty_queries(spark):
    rows = table(spark, row("a", "word"), row("b", "word", expires=NOW), row("c", "word", deleted=NOW), row("d", "else", days=1))
    assert ids(search.search(rows, "word", visible(), NOW)) == ["a"]
    fallback = search.search(rows, "?!", visible(), NOW)
    assert ids(fallback) == ["a", "d"] and {r["score"] for r in fallback.collect()} == {0.0}
    assert search.search(rows.limit(0), "word", visible(), NOW).count() == 0


def test_phrase_terms_need_adjacent_tokens(spark):
    rows = table(spark, row("a", "foo bar"), row("b", "bar foo"), row("c", "foo x bar"))
    assert {r["id"] for r in lexical.scored(rows, "foo_bar").collect()} == {"a"}


def test_bm25_by_hand(spark):
    import math

    texts = {"a": "one two two", "b": "two", "c": "three four five six"}
    rows = table(spark, *(row(k, v) for k, v in texts.items()))
    got = {r["id"]: r["bm25"] for r in lexical.scored(rows, "two one").collect()}
    mean = sum(len(t.split()) for t in texts.values()) / 3
    for k in ("a", "b"):
        want, words = 0.0, texts[k].split()
        for term in ("two", "one"):
            df = sum(term in t.split() for t in texts.values())
            idf = math.log((3 - df + 0.5) / (df + 0.5))
            tf = words.count(term)
            want -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got[k] == pytest.approx(want)
    assert set(got) == {"a", "b"}


def test_chunks_win_over_their_row(spark):
    rows = table(spark, row("long", "whole text", embedding=[0.0, 1.0]))
    parts = spark.createDataFrame([("long", 0, "first part", [0.0, 1.0]), ("long", 1, "second part", [1.0, 0.0])], "parent_id string, chunk_index int, content string, embedding array<double>")
    assert search.search(rows, "zzz", visible(), NOW, vector=[1.0, 0.0], min_score=0.55).count() == 0
    found = search.search(rows, "zzz", visible(), NOW, vector=[1.0, 0.0], chunks=parts, min_score=0.55).collect()
    assert [r["content"] for r in found] == ["second part"]


def test_packing_skips_and_continues(spark):
    rows = table(spark, *(row(f"r{k}", "x" * n) for k, n in enumerate((4000, 40, 4000, 40))))
    ranked = rows.withColumn("rank", F.substring("id", 2, 1).cast("int") + 1)
    assert [r["id"] for r in search.pack_tokens(ranked, 1060).orderBy("place").collect()] == ["r0", "r1"]
    assert [r["id"] for r in search.pack_tokens(ranked, 10).orderBy("place").collect()] == ["r0"]
    assert [r["id"] for r in search.pack_bytes(ranked, 700, max_chars=5000).orderBy("place").collect()] == ["r1", "r3"]
    cut = search.pack_bytes(ranked, 2000, max_chars=4000).orderBy("place").collect()  # the first is tried again with a quarter
    assert [r["id"] for r in cut] == ["r0", "r1", "r3"] and cut[0]["content"].startswith("x" * 1000 + "\n… [truncated 3000")
    assert search.pack_tokens(ranked.limit(0)).count() == 0


def test_canonical_winner_is_most_specific_then_newest(spark):
    rows = table(spark, row("g", "Favorite x: a", key="favorite_x", days=0), row("p", "Favorite x: b", ("project", "p"), key="favorite_x", days=9), row("o", "Favorite y: b", key="favorite_y", days=3), row("n", "Favorite y: c", key="favorite_y", days=2))
    assert {(r["canonical_key"], r["id"]) for r in canonical.winners(rows).collect()} == {("favorite_x", "p"), ("favorite_y", "n")}


def test_versions_begin_at_changes_and_deletions(spark):
    at = lambda k, c, d=None: (f"i{k}", k, "global", None, c, [], 0.5, False, "k", c, None, NOW, NOW, None, d)
    rows = spark.createDataFrame([at(1, "A"), at(2, "B"), at(3, "B"), at(4, "A", NOW), at(5, "A")], SCHEMA)
    assert [r["version"] for r in canonical.versions(rows).orderBy("seq").collect()] == [1, 2, 2, 3, 4]


def test_preferences_replace_by_winners(spark):
    tags = ["canonical"]
    rows = table(spark, row("old", "Favorite editor: red", tags=tags, key="favorite_editor", days=5), row("new", "Favorite editor: blue", tags=tags, key="favorite_editor"), row("x", "Favorite tree: oak", tags=tags, key="favorite_tree"))
    assert ids(canonical.preferred(rows, ["favorite", "editor"], NOW)) == ["new"]
    assert set(ids(canonical.preferred(rows, ["zebra"], NOW))) == {"new", "x"}  # no match at all: every key's winner
    candidates = lambda terms: {r["id"]: r["match"] for r in canonical.preference_candidates(rows, terms, NOW).collect()}
    assert candidates(["favorite", "editor", "blue"]) == {"old": 2, "new": 3} and candidates(["tree", "zebra"]) == {"x": 1}
    found = search.search(rows, "oak", visible(), NOW)
    best = canonical.preferred(rows, ["favorite", "tree"], NOW, found).collect()
    assert [r["id"] for r in best] == ["x"] and best[0]["effective"] == pytest.approx(max(0.9, found.first()["score"]))
    plain = table(spark, row("a", "one plain note"), row("b", "another plain note", days=1))
    assert [r["id"] for r in canonical.preferred(plain, ["zebra"], NOW, search.search(plain, "plain", visible(), NOW)).orderBy("rank").collect()] == ["a", "b"]


def test_context_and_responses(spark):
    rows = table(spark, row("g", "Favorite editor: red", tags=["canonical"], key="favorite_editor", days=3), row("p", "Favorite editor: blue", ("session", "s"), tags=["canonical"], key="favorite_editor"),
                 row("d", "Favorite editor: white", tags=["canonical"], key="favorite_editor", days=9, deleted=NOW), row("n", "a note on the editor " + "x" * 9000), row("q", "Favorite editor: other session", ("session", "t"), key="favorite_editor"))
    asked = search.context(rows, "what was my favorite editor previously", NOW, session_id="s")
    assert [r["id"] for r in asked.items.orderBy("place").collect()] == ["p"] and asked.summary.first()["summary"] == "1. [session] Favorite editor: blue"
    assert [r["scope_type"] for r in asked.scopes.collect()] == ["session"] and [r["id"] for r in asked.timeline.collect()] == ["p", "g", "d"]
    assert search.prompt(asked).first()["prompt"] == "[Memory Context Summary]\n1. [session] Favorite editor: blue\n\n[Retrieved Memory Items]\n1. [session] Favorite editor: blue"
    plain = search.context(rows, "editor note", NOW, session_id="s", token_budget=1, max_items=99)
    assert {r["id"] for r in plain.items.collect()} == {"p", "g"} and plain.timeline is None  # at least 200 tokens; the long note does not fit
    assert search.context(rows.limit(0), "editor", NOW).summary.first()["summary"] == "No relevant memory found."
    shaped = search.response(rows, "editor", visible(everything=True), NOW, max_bytes=1, max_chars=7).orderBy("place").collect()
    assert {r["total"] for r in shaped} == {4} and shaped[0]["used"] <= 1000 and all(len(r["content"]) < 160 for r in shaped)
    assert search.compact_response(rows, "editor", visible(), NOW).count() == 2
