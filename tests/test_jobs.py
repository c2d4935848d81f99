import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators import chunks, facts, ingest, jobs, maintenance, tools, trees
from tesserae.plans.scope import Scope
from tesserae.sources import embeddings, exports, logs
from tesserae.streaming import turns

NOW = datetime(2024, 3, 1)
STORE = "id string, scope_type string, scope_id string, content string, content_hash string, canonical_key string, tags array<string>, importance double, captured boolean, source_agent string, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp, seq long"
BATCH = "seq long, at timestamp, idempotency_key string, scope_type string, scope_id string, content string, tags array<string>, importance double, ttl_days int, key string, captured boolean, source_agent string"


def write(seq, content, tags=(), importance=None, scope=("global", None), key=None, ttl=None, idem=None, agent=None):
    return (seq, NOW + timedelta(minutes=seq), idem, *scope, content, list(tags), importance, ttl, key, None, agent)


def stored(spark, *writes, store=None):
    store = spark.createDataFrame([], STORE) if store is None else store
    return ingest.upsert(store, spark.createDataFrame(list(writes), BATCH))


def test_equal_contents_merge(spark):
    rows = stored(spark, write(1, " same text ", ["a"], 0.3), write(2, "same text", ["b", "a"], None, agent="x"), write(3, "same text", scope=("session", "s")), write(4, "  ")).collect()
    both = next(r for r in rows if r["scope_type"] == "global")
    assert len(rows) == 2 and both["tags"] == ["a", "b"] and both["importance"] == 0.3 and both["source_agent"] == "x" and both["expires_at"] is None
    session = next(r for r in rows if r["scope_type"] == "session")
    assert session["expires_at"] == session["created_at"] + timedelta(days=14)


def one_by_one(store, writes):
    """Rows as (content, key, live, tags) after each write in turn: the rule, without windows."""
    rows = [dict(r) for r in store]
    for content, key, tags in writes:
        row = next((r for r in rows if r["live"] and r["content"] == content), None)
        if row is None:
            rows.append(row := {"content": content, "key": key, "live": True, "tags": list(tags)})
        else:
            row["key"], row["tags"] = key or row["key"], list(dict.fromkeys([*row["tags"], *tags]))
        for r in rows:
            if r is not row and r["live"] and r["key"] and r["key"] == row["key"]:
                r["live"] = False
    return rows


def test_batches_equal_writes_one_by_one(spark):
    """Contents with and without keys, onto a store with rows; each content has one key at most."""
    import random

    rng, got, want = random.Random(4), [], []
    key_of = {"a": "k1", "b": "k1", "c": "k2", "d": None}
    first, second = [], []
    for case in range(40):
        scope, seen = ("session", f"s{case}"), []
        for batch in (first, second):
            for _ in range(rng.randint(0, 5)):
                content = rng.choice("abcd")
                named = key_of[content] and rng.random() < 0.6
                seen.append((content, key_of[content] if named else None, [rng.choice("xyz")]))
                batch.append(write(len(first) + 1000 * len(second), content, seen[-1][2], scope=scope, key=seen[-1][1], ttl=5))
        want += [(f"s{case}", r["content"], r["key"], r["live"], sorted(r["tags"])) for r in one_by_one([], seen)]
    rows = stored(spark, *second, store=stored(spark, *first))
    got = [(r["scope_id"], r["content"], r["canonical_key"], r["deleted_at"] is None, sorted(r["tags"])) for r in rows.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 60


def test_results_without_a_known_call(spark):
    rows = [("s", 1, "result", None, "9", "from a Web Search"), ("s", 2, "result", None, None, "else"), ("s", 3, "call", "shell", "1", None), ("s", 4, "result", None, "1", None), ("s", 5, "uses", None, None, None)]
    events = spark.createDataFrame(rows, "session string, pos long, kind string, name string, call_id string, content string").withColumn("n", F.when(F.col("kind") == "uses", 2))
    all_, known = (tools.assistance(events, unknown_results=x).first() for x in (True, False))
    assert (all_["tool_results"], all_["web_calls"], all_["names"]) == (3, 3, ["server_web_tool", "shell"]) and known["tool_results"] == 2


def test_a_b_a_makes_three_versions(spark):
    pref = ["canonical"]
    rows = stored(spark, write(1, "Favorite x: a", pref), write(2, "Favorite x: b", pref), write(3, "Favorite x: b", pref), write(4, "Favorite x: a", pref)).orderBy("seq").collect()
    assert [(r["content"], r["deleted_at"] is None) for r in rows] == [("Favorite x: a", False), ("Favorite x: b", False), ("Favorite x: a", True)]
    assert len({r["id"] for r in rows}) == 3 and {r["canonical_key"] for r in rows} == {"favorite_x"}


def test_batches_build_on_the_store(spark):
    first = stored(spark, write(1, "Favorite x: a", ["canonical"]), write(2, "plain", ["t"]))
    second = stored(spark, write(3, "Favorite x: b", ["canonical"]), write(4, "plain", ["u"], ttl=2), store=first).orderBy("seq").collect()
    old = {r["content"]: r["id"] for r in first.collect()}
    plain = next(r for r in second if r["content"] == "plain")
    assert len(second) == 3 and plain["id"] == old["plain"] and plain["tags"] == ["t", "u"] and plain["expires_at"] is not None
    assert next(r for r in second if r["content"] == "Favorite x: a")["deleted_at"] is not None


def test_replays_are_dropped(spark):
    store = stored(spark, write(1, "hello there", idem="k"))
    keys = store.select(F.lit("k").alias("key"), F.col("id").alias("memory_id"), F.lit(1).alias("seq"))
    batch = spark.createDataFrame([write(2, "hello there", idem="k"), write(3, "changed", idem="k"), write(4, "hello there", idem="other")], BATCH)
    assert [r["seq"] for r in ingest.drop_replays(batch, store, keys).orderBy("seq").collect()] == [3, 4]


def test_secrets_never_reach_the_store(spark):
    rows = stored(spark, write(1, "token ghp_" + "a1B2" * 6)).collect()
    assert rows[0]["content"] == "token [REDACTED_GITHUB_TOKEN]"


def test_delete_forget_and_repair(spark):
    store = stored(spark, write(1, "one text"), write(2, "two text", scope=("session", "s")), write(3, "three text", scope=("session", "s")))
    gone = lambda df: {r["content"] for r in df.where("deleted_at is not null").collect()}
    first = store.where("content = 'one text'").first()["id"]
    assert gone(ingest.delete(store, [first], NOW)) == {"one text"}
    assert gone(ingest.forget(store, Scope("session", "s"), NOW)) == {"two text", "three text"}
    assert gone(ingest.forget(store, Scope("session", "s"), NOW, NOW + timedelta(minutes=2))) == {"two text"}
    legacy = spark.createDataFrame([(str(k), "global", None, f"Favorite z: {k}", str(k), None, ["canonical"], 0.5, False, None, NOW, NOW + timedelta(days=k), None, None, k) for k in range(3)], STORE)
    fixed = ingest.repaired(legacy)
    assert gone(fixed) == {"Favorite z: 0", "Favorite z: 1"} and {r["canonical_key"] for r in fixed.collect()} == {"favorite_z"}


def test_capture_takes_best_facts(spark):
    texts = spark.createDataFrame([(1, NOW, "global", None, "We must always remember the owner.\nwe must always remember the owner.\nAn ordinary sentence of some length here.")], "seq long, at timestamp, scope_type string, scope_id string, text string")
    batch = ingest.capture(texts, 1).collect()
    assert [r["content"] for r in batch] == ["We must always remember the owner."] and batch[0]["captured"]
    assert facts.candidates(texts, hint=F.lit("A hint that is long enough to count")).count() == 3


def health_row(id, days, tags=(), expires=None, key=None, captured=False, scope="global", agent=None, deleted=None):
    at = NOW - timedelta(days=days)
    return (id, scope, None, f"content {id}", list(tags), captured, key, agent, None, at, at, expires, deleted)


HEALTH = "id string, scope_type string, scope_id string, content string, tags array<string>, captured boolean, canonical_key string, source_agent string, embedding array<double>, created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp"


def test_cleanup(spark):
    rows = spark.createDataFrame([
        health_row("expired", 60, expires=NOW - timedelta(days=8)), health_row("fresh-expired", 60, expires=NOW - timedelta(days=1)), health_row("captured", 60, captured=True), health_row("young", 10, captured=True),
        health_row("kept", 60, ["canonical"], NOW - timedelta(days=30)), health_row("keyed", 60, expires=NOW - timedelta(days=30), key="k"), health_row("both", 60, ["captured"], NOW - timedelta(days=30)),
    ], HEALTH)
    names = lambda df: {r["id"] for r in df.collect()}
    assert names(maintenance.expired_candidates(rows, NOW)) == {"expired", "both"}
    assert names(maintenance.captured_candidates(rows, NOW)) == {"captured"}
    assert names(maintenance.apply_cleanup(rows, NOW).where("deleted_at is not null")) == {"expired", "both", "captured"}


def test_durability_and_health(spark):
    rows = spark.createDataFrame([
        health_row("a", 1, ["sensitive"]), health_row("b", 1, ["currentness-sensitive"]), health_row("c", 1, agent="cli-import"), health_row("d", 1, ["style"]), health_row("e", 1, ["design"], scope="project"),
        health_row("f", 1, captured=True, scope="session"), health_row("g", 1), health_row("h", 1, deleted=NOW), health_row("i", 90),
    ], HEALTH)
    got = {r["class"]: r["rows"] for r in maintenance.audit(rows, NOW).collect()}
    assert got == {"sensitive": 1, "currentness_sensitive": 1, "transcript_provenance": 1, "durable_global_preference": 1, "durable_project_memory": 1, "ephemeral_noise": 1, "unclassified": 1}
    of = {r["class"]: r for r in maintenance.audit(rows.where("id <> 'g'"), NOW, samples=1).collect()}
    assert [x["id"] for x in of["sensitive"]["samples"]] == ["a"] and of["sensitive"]["reason"] == "explicit sensitive tag" and of["sensitive"]["ignored"]
    assert (of["unclassified"]["rows"], of["unclassified"]["samples"], of["durable_project_memory"]["ignored"]) == (0, [], False)
    assert [r["at"] for r in maintenance.kept_history(spark.createDataFrame([(k,) for k in range(9)], "at int"), 2).collect()] == [8, 7]
    stats = maintenance.health(rows, NOW).first()
    assert (stats["total"], stats["active"], stats["soft_deleted"], stats["embedding_rows"], stats["avg_embedding_bytes"]) == (9, 8, 1, 0, 0)
    empty = maintenance.health(rows.limit(0), NOW).first()
    assert empty["total"] == 0 and empty["max_content_bytes"] == 0
    assert {r["scope_type"]: r["active"] for r in maintenance.scope_counts(rows.limit(0), NOW).collect()} == {"global": 0, "project": 0, "session": 0}
    assert maintenance.missing_embeddings(rows, 9).count() == 8


def test_drift(spark):
    days = [(NOW + timedelta(days=k), 10 + (600 if k == 7 else 0), 5, 1000 + 100 * k, 1 if k >= 5 else 0) for k in range(8)]
    found = maintenance.drift(spark.createDataFrame(days, "at timestamp, active long, keys long, bytes long, expired_active long")).orderBy("at").collect()
    assert found[0]["day_growth"] is None and found[1]["alerts"] == "db_growth_day"
    assert found[7]["week_growth"] == pytest.approx(600 / 1100) and found[7]["streak"] == 3
    assert found[7]["alerts"] == "db_growth_day,db_growth_week,active_growth_day,expired_active_streak"
    large = lambda k, embedded, over, cut, state="ok": (NOW + timedelta(days=k), 10, 5, 1000, 0, state, embedded, 2 << 20, over, cut)
    rows = [large(0, 9, 0, 0), large(1, 10, 3, 2), large(2, 10, 3, 3), large(3, 10, 0, 0, "degraded")]
    found = maintenance.drift(spark.createDataFrame(rows, "at timestamp, active long, keys long, bytes long, expired_active long, embeddings string, embedding_rows long, max_content_bytes long, oversized_rows long, chunked_rows long")).orderBy("at").collect()
    assert [(r["alerts"], r["notices"]) for r in found] == [("max_content_outlier", ""), ("max_content_outlier", ""), ("", "max_content_outlier_chunked"), ("embeddings_degraded", "max_content_outlier_embedded")]


def test_logs_of_both_formats(spark, tmp_path):
    a = [
        {"timestamp": "t1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": " hi "}, {"type": "image"}, {"type": "input_text", "text": "there"}]}},
        {"timestamp": "t2", "type": "response_item", "payload": {"type": "message", "role": "assistant", "phase": "commentary", "content": [{"type": "output_text", "text": "no"}]}},
        {"timestamp": "t3", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}},
        {"timestamp": "t4", "type": "response_item", "payload": {"type": "function_call", "name": "memory_search", "call_id": "1"}},
        {"timestamp": "t5", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "1"}},
        {"timestamp": "t6", "type": "response_item", "payload": {"type": "function_call", "name": "web_search", "call_id": "2"}},
        {"timestamp": "t7", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "2"}},
    ]
    b = [
        {"timestamp": "u1", "type": "user", "message": {"role": "user", "content": "plain text"}},
        {"timestamp": "u2", "type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "two"}]}},
        {"timestamp": "u3", "type": "assistant", "message": {"role": "user", "content": "mismatch"}},
        {"timestamp": "u4", "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "z"}]}},
    ]
    for name, rows in (("a", a), ("b", b)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.jsonl").write_text("\n".join([*map(json.dumps, rows), "not json", ""]))
    lines = logs.read(spark, str(tmp_path / "a"))
    assert [(r["role"], r["text"]) for r in logs.messages_a(lines).collect()] == [("user", "hi\nthere")]
    found = tools.assistance(logs.tool_events_a(lines)).first()
    assert (found["tool_calls"], found["tool_results"], found["web_calls"], found["own_calls"], found["own_results"], found["assisted"]) == (1, 1, 2, 1, 1, True)  # a call to the web and its result
    other = logs.messages_b(logs.read(spark, str(tmp_path / "b")))
    assert [(r["role"], r["text"]) for r in other.orderBy("pos").collect()] == [("user", "plain text"), ("assistant", "one\ntwo")]
    assert logs.transcripts(other).first()["transcript"] == "[u1] User: plain text\n\n[u2] Assistant: one\ntwo"
    assert logs.tail(other, 1).first()["text"] == "one\ntwo"
    files = logs.newest_files(spark, str(tmp_path))
    assert files.count() == 2 and logs.unseen(files, files.limit(1)).count() == 1


def test_tools_of_format_b(spark):
    part = lambda **x: x
    rows = [
        {"type": "assistant", "message": {"content": [part(type="tool_use", id="1", name="memory_search"), part(type="tool_use", id="2", name="Bash"), part(type="text", text="x")], "usage": {"server_tool_use": {"web_search_requests": 2, "web_fetch_requests": 1}}}},
        {"type": "user", "message": {"content": [part(type="tool_result", tool_use_id="1", content="own"), part(type="tool_result", tool_use_id="2", content="by Web Search"), part(type="tool_result", tool_use_id="?", content="z")]}},
        {"type": "user", "toolUseResult": {"text": "alone"}, "message": {"content": "plain"}},
    ]
    lines = spark.createDataFrame([("s", k, json.dumps(r)) for k, r in enumerate(rows)] + [("t", 0, "not json")], "session string, pos int, line string")
    (found,) = tools.assistance(logs.tool_events_b(lines)).collect()
    assert (found["tool_calls"], found["tool_results"], found["web_calls"], found["own_calls"], found["own_results"], found["assisted"]) == (1, 3, 4, 1, 1, True)
    assert found["names"] == ["Bash", "server_web_tool"]


def test_import_of_sessions(spark):
    from tesserae.plans.scope import project_id

    said = [("s", k, f"t{k}", "user" if k % 2 else "assistant", f"We must always remember the deadline number {k}.") for k in range(5)] + [("t", 0, "t0", "user", "Never touch the main repo, owner is Kim.")]
    messages = spark.createDataFrame(said, "session string, pos int, at string, role string, text string")
    assisted = spark.createDataFrame([("t", True)], "session string, assisted boolean")
    empty = spark.createDataFrame([], STORE)
    done = jobs.import_sessions(empty, messages, NOW, "codex-session", assisted, max_messages=3, project_path="/p")
    report = {r["session"]: r for r in done.report.collect()}
    assert (report["s"]["messages"], report["s"]["truncated"], report["t"]["capture_skipped"], report["s"]["created"]) == (3, 2, True, True)
    rows = done.store.collect()
    whole = {r["scope_id"]: r for r in rows if "transcript" in r["tags"]}
    assert whole["s"]["content"].startswith("Imported Codex session transcript from s\n\n[t2] Assistant: We must") and "tool-assisted" in whole["t"]["tags"] and whole["s"]["expires_at"] == NOW + timedelta(days=30)
    assert whole["t"]["metadata"] == {"source_agent": "codex-session-import", "source_session_file": "t", "project_path": "/p", "capture_skipped": "true", "capture_skip_reason": "tool_assisted"}
    facts = [r for r in rows if "captured" in r["tags"]]
    assert {(r["scope_type"], r["scope_id"], r["expires_at"]) for r in facts} == {("project", project_id("/p"), None)} and report["s"]["facts_created"] == len(facts) == 4  # the hint is a fact too
    again = jobs.import_sessions(done.store, messages, NOW, "codex-session", assisted, max_messages=3, project_path="/p")
    assert again.store.count() == len(rows) and {r["facts_known"] for r in again.report.collect()} == {0, 4}
    own = jobs.import_sessions(empty, messages, NOW, "claude-session", capture_scope="session").store.where("captured").collect()
    assert {r["scope_id"] for r in own} == {"s", "t"} and {r["expires_at"] for r in own} == {NOW + timedelta(days=14)}
    with pytest.raises(ValueError, match="path"):
        jobs.import_sessions(empty, messages, NOW, "codex-session")


def test_sessions_of_one_number_are_kept_apart(spark, monkeypatch):
    """Whatever a hash of the key gives, each session has a number of its own."""
    monkeypatch.setattr(jobs.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    said = [(f"s{k}", 0, "t", "user", f"We must always remember the deadline of team {k}.") for k in range(12)]
    done = jobs.import_sessions(spark.createDataFrame([], STORE), spark.createDataFrame(said, "session string, pos int, at string, role string, text string"), NOW, "codex-session", capture_scope="session")
    assert done.store.where("captured").where("content like '%deadline of team%'").count() == 12
    assert {r["facts_created"] for r in done.report.collect()} == {2}


def test_import_of_conversations(spark):
    from tesserae.plans.scope import project_id

    nodes = [("c", "1", None, "user", 1.0, "The owner of the repo is always Kim."), ("c", "2", "1", "assistant", 2.0, "ok"), ("c", "3", "2", "system", 3.0, "no"), ("c", "4", "1", "assistant", None, "another branch is what we always prefer"), ("d", "1", None, "system", None, "only this")]
    nodes = spark.createDataFrame(nodes, "conv string, id string, parent string, role string, time double, text string")
    convs = lambda updated: spark.createDataFrame([("c", "A title", 0.5, updated, "2", f"k:{updated}"), ("d", None, None, None, None, "k:d")], "conv string, title string, created double, updated double, current string, key string")
    empty, no_keys = spark.createDataFrame([], STORE), spark.createDataFrame([], "key string, memory_id string, seq long")
    first = jobs.import_conversations(empty, no_keys, convs(9.0), nodes, NOW, project_path="/p")
    rows = first.store.collect()
    (whole,) = [r for r in rows if "transcript" in r["tags"]]
    assert whole["content"] == "Imported ChatGPT conversation transcript\nConversation ID: c\nTitle: A title\nModel: unknown\nArchived: false\nSource shard: \nSource export zip: \n\n[1970-01-01T00:00:01.000Z] User: The owner of the repo is always Kim.\n[1970-01-01T00:00:02.000Z] Assistant: ok"
    assert whole["expires_at"] == NOW + timedelta(days=3650) and whole["metadata"]["source_conversation_id"] == "c" and whole["metadata"]["branch_strategy"] == "current"
    facts = [r for r in rows if "captured" in r["tags"]]
    assert facts and {(r["scope_id"], r["expires_at"], tuple(r["tags"])) for r in facts} == {(project_id("/p"), None, ("import", "chatgpt-export", "captured", "chatgpt-conv:c"))}
    assert any(r["content"].startswith("Extract durable preferences") and r["content"].endswith("imported ChatGPT conversation.") for r in facts)
    assert jobs.summary(first.report).first().asDict() == {"processed": 1, "created": 1, "skipped": 0, "messages": 2, "filtered": 0, "n_errors": 0, "errors": []}
    again = jobs.import_conversations(first.store, first.keys, convs(9.0), nodes, NOW, project_path="/p")
    assert jobs.summary(again.report).first()["skipped"] == 1 and again.store.where("deleted_at is null").count() == len(rows)
    other = ingest.upsert(first.store, spark.createDataFrame([(*write(99, "a fact of another conversation", ["import", "chatgpt-export", "captured", "chatgpt-conv:x"])[:3], "project", project_id("/p"), *write(99, "a fact of another conversation", ["import", "chatgpt-export", "captured", "chatgpt-conv:x"])[5:])], BATCH))
    later = jobs.import_conversations(other, first.keys, convs(10.0), nodes, NOW, strategy="all", project_path="/p")
    live = later.store.where("deleted_at is null").collect()
    assert jobs.summary(later.report).first()["created"] == 1 and sum("transcript" in r["tags"] for r in live) == 1
    assert any("another branch" in r["content"] for r in live if "captured" in r["tags"]) and any("another conversation" in r["content"] for r in live)
    assert len({r["id"] for r in later.store.collect()}) == later.store.count()


def test_summary_keeps_the_first_errors(spark):
    report = spark.createDataFrame([("c", 2, True)], "conv string, messages int, created boolean")
    errors = spark.createDataFrame([(k, f"e{k}") for k in range(150, 0, -1)], "place long, message string")
    found = jobs.summary(report, 3, errors).first()
    assert (found["filtered"], found["n_errors"], found["errors"]) == (3, 150, [f"e{k}" for k in range(1, 101)])


def test_parents_coverage_and_newest_file(spark):
    long = "x" * 40
    store = stored(spark, write(1, long + "1", ["import", "transcript"]), write(2, "short", ["Import", "Transcript"]), write(3, long + "3", ["transcript"]))
    store = store.withColumn("expires_at", F.lit(None).cast("timestamp"))
    ids = {r["content"]: r for r in store.collect()}
    assert [r["content"] for r in jobs.transcript_parents(store, NOW, 10).collect()] == [long + "1"]
    assert jobs.transcript_parents(store.withColumn("expires_at", F.lit(NOW)), NOW, 1).count() == 0
    row = ids[long + "1"]
    made = spark.createDataFrame([(row["id"], "v1", row["content_hash"])], "parent_id string, version string, parent_hash string")
    assert jobs.coverage(store, made, "v1", NOW, 10).first().asDict() == {"oversized_rows": 1, "chunked_rows": 1}
    assert jobs.coverage(store, made, "v2", NOW, 10).first().asDict() == {"oversized_rows": 1, "chunked_rows": 0}
    lines = spark.createDataFrame([("a", NOW, 0, "cwd /p/x"), ("b", NOW + timedelta(hours=1), 0, "cwd /p/x"), ("c", NOW + timedelta(hours=2), 0, "/q"), ("d", NOW - timedelta(days=1), 0, "/p/old")], "session string, modified timestamp, pos int, line string")
    assert jobs.newest_of_project(lines, "/p/x").first()["session"] == "b"
    assert jobs.newest_of_project(lines, "/p/old", NOW).count() == 0 and jobs.newest_of_project(lines, "/p/old", NOW - timedelta(days=1) + timedelta(seconds=59)).count() == 1


def test_metadata_is_merged(spark):
    rows = [(*write(1, "one"), {"a": "1", "b": "1"}), (*write(2, "one"), None), (*write(3, "one"), {"b": "2", "c": "3"}), (*write(4, "two"), None)]
    batch = spark.createDataFrame(rows, BATCH + ", metadata map<string,string>")
    first = ingest.upsert(spark.createDataFrame([], STORE), batch)
    assert {r["content"]: r["metadata"] for r in first.collect()} == {"one": {"a": "1", "b": "2", "c": "3"}, "two": None}
    second = ingest.upsert(first, spark.createDataFrame([write(5, "one", ["t"])], BATCH))
    assert second.where(ingest.metadata_is("c", "3")).first()["tags"] == ["t"] and second.count() == 2


def test_chunk_runs(spark):
    parents = spark.createDataFrame([("a", "x" * 50, "h1"), ("b", "y" * 30, "h2"), ("c", "short", "h3")], "id string, content string, content_hash string")
    none = spark.createDataFrame([], "parent_id string, chunk_index int, start_byte int, end_byte int, content string, version string, parent_hash string")
    plan = chunks.estimate(parents, none, 20, 5, 10).first()
    assert plan.asDict() == {"parents": 2, "unchanged": 0, "rebuild": 2, "chunks": 5, "chunk_bytes": 95, "largest": "a", "largest_bytes": 50}
    made = chunks.rebuilt(parents, none, 20, 5, 10)
    again = chunks.rebuilt(parents.withColumn("content_hash", F.when(F.col("id") == "b", "new").otherwise(F.col("content_hash"))), made, 20, 5, 10).collect()
    assert len(again) == 5 and {r["parent_hash"] for r in again if r["parent_id"] == "b"} == {"new"} and chunks.estimate(parents, made, 20, 5, 10).first()["unchanged"] == 2


def test_bindings_orders_and_names(spark):
    store = stored(spark, write(1, "Favorite x: a", ["canonical"]), write(2, "Favorite x: b", ["canonical"]), write(3, "plain"))
    ids = {r["content"]: r["id"] for r in store.collect()}
    keys = spark.createDataFrame([("k1", ids["Favorite x: a"], 1), ("k2", ids["plain"], 2), ("k3", "gone", 3)], "key string, memory_id string, seq long")
    assert {r["key"]: r["memory_id"] for r in ingest.repaired_bindings(keys, store).collect()} == {"k1": ids["Favorite x: b"], "k2": ids["plain"], "k3": "gone"}
    first = lambda order: maintenance.in_order(store, order, 1).first()["content"]
    assert (first("oldest"), first("newest"), first("smallest")) == ("Favorite x: a", "plain", "plain")
    names = spark.createDataFrame([("/a/b/log.1.jsonl",), ("x" * 200,)], "f string").select(logs.session_id(F.col("f"))).collect()
    assert [r[0] for r in names] == ["import-log.1", "import-" + "x" * 113]


def test_touched_rows(spark):
    store = stored(spark, write(1, "one"), write(2, "two"))
    one = store.where("content = 'one'").select("id")
    assert {r["content"]: r["last_accessed_at"] for r in ingest.touched(store, one, NOW).collect()} == {"one": NOW, "two": None}


def test_exports_and_trees(spark, tmp_path):
    node = lambda parent, text=None, at=None: {"parent": parent, "message": {"author": {"role": "user"}, "create_time": at, "content": {"parts": [text]}} if text else None}
    conv = {"conversation_id": " c1 ", "title": "T", "update_time": 1700000000, "current_node": "leaf", "mapping": {"root": node(None), "a": node("root", "x", 1.0), "leaf": node("a", "y", 2.0), "b": node("a", "z", 3.0), "d": node("b", "w")}}
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("conversations-000.json", json.dumps([conv]))
        z.writestr("conversations-001.json", "{broken")
        z.writestr("other.json", "[]")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = exports.read(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 2
    convs = exports.conversations(rows)
    first = convs.first()
    assert (first["conv"], first["key"]) == ("c1", "chatgpt-export:v1:conv:c1:update:1700000000")
    nodes = exports.nodes(convs)
    assert trees.active_paths(convs.select("conv", "current"), nodes).first()["path"] == ["root", "a", "leaf"]
    assert trees.longest_paths(nodes).first()["path"] == ["root", "a", "b", "d"]
    assert [r["id"] for r in trees.all_nodes(nodes).orderBy("place").collect()] == ["a", "leaf", "b", "d", "root"]
    loop = spark.createDataFrame([("c", "x", "y"), ("c", "y", "x")], "conv string, id string, parent string")
    assert trees.active_paths(spark.createDataFrame([("c", "x")], "conv string, current string"), loop).first()["path"] == ["y", "x"]
    assert exports.message_text({"parts": ["  hello  ", {}, "hello", "world"]}) == "hello\nworld"
    assert exports.covered(convs, F.lit("2023-12-01").cast("timestamp")).count() == 1 and exports.covered(convs, F.lit("2025-12-01").cast("timestamp")).count() == 0


def test_embedding_backfill(spark):
    rows = spark.createDataFrame([("a", "some words"), ("b", "bad"), ("c", "é" * 10)], "id string, content string")

    class Picky(embeddings.Hashed):
        def embed(self, texts):
            if "bad" in texts:
                raise OSError
            return super().embed(texts)

    got = {r["id"]: r["embedding"] for r in embeddings.backfill(rows, embeddings.Hashed(4)).collect()}
    assert all(len(v) == 4 for v in got.values())
    assert embeddings.embed_safely(Picky(4), ["x", "bad"])[1] is None
    assert rows.select(embeddings.input_of(F.col("content"), 5).alias("t")).collect()[2]["t"].rstrip("�") == "éé"
    with pytest.raises(RuntimeError):
        embeddings.backfill(rows, embeddings.Disabled())


def test_streamed_turns_equal_batch(spark, tmp_path):
    at = lambda k: NOW + timedelta(minutes=k)
    events = [("s", "prompt", "hello", at(0)), ("s", "stop", "hi", at(1)), ("s", "prompt", "/cmd", at(2)), ("s", "stop", "done", at(3)), ("t", "prompt", "open", at(4)), ("s", "stop", "alone", at(5))]
    frame = spark.createDataFrame(events, "session string, kind string, text string, at timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = turns.turns(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["session"], r["prompt"], r["answer"]) for r in spark.table("turns").collect()] == [("s", "hello", "hi")]


def test_replayed_stream_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("k", NOW, "a", 1.0), ("k", NOW, "a", 1.0), ("l", NOW + timedelta(minutes=40), "a", 2.0)], "idempotency_key string, ts timestamp, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = turns.first_of_key(stream, at="ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 2
    assert turns.event_windows(rows, size="1 hour", slide="30 minutes").count() == 3
    assert turns.sessions(rows, key="event_type").count() == 2
