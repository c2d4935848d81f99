"""Incremental merges against whole ones and a sequential model; versions, conflicts, dead writers, streams sent twice."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ingest, merge
from tesserae.queries import STORE
from tesserae.sources.store import Conflict, Store
from tesserae.streaming.ingest import into_store

BATCH = "seq long, at timestamp, idempotency_key string, scope_type string, scope_id string, content string, tags array<string>, importance double, ttl_days int, key string, captured boolean, source_agent string"
T0 = datetime(2024, 1, 1)


def batch(spark, rows, start=0):
    """rows: (content, tags, scope_id or None, idempotency_key)."""
    return spark.createDataFrame([(k, T0 + timedelta(minutes=start + k), i, "session" if s else "global", s, c, t, None, 3650, None, False, "a") for k, (c, t, s, i) in enumerate(rows)], BATCH)


def random_rows(rng, n):
    out = []
    for k in range(n):
        favourite = rng.random() < 0.5
        content = f"Favorite {rng.choice('xyz')}: {rng.choice('abc')}" if favourite else f"note {rng.randrange(6)}"
        out.append((content, rng.choice((["canonical"], ["canonical"], ["plain"])) if favourite else [f"t{k % 3}"], rng.choice((None, "s1", "s2")), rng.choice((None, f"k{rng.randrange(5)}"))))
    return out


class Model:
    """One write at a time, as the store is told to behave."""

    def __init__(self):
        self.rows, self.keys = [], {}  # rows: dicts in order of creation

    def write(self, content, tags, scope, idem):
        key = f"favorite_{content.split(' ')[1][0]}" if "canonical" in tags else None
        bound = self.keys.get(idem) if idem else None
        if bound and bound["live"] and bound["scope"] == scope and bound["content"] == content:
            return {"row": bound, "created": False, "replaced": [], "replay": True}
        row = next((r for r in self.rows if r["live"] and r["scope"] == scope and r["content"] == content), None)
        created = row is None
        if created:
            row = {"scope": scope, "content": content, "live": True, "key": key, "tags": []}
            self.rows.append(row)
        row["key"] = key or row["key"]
        row["tags"] += [t for t in tags if t not in row["tags"]]
        replaced = [r for r in self.rows if r is not row and r["live"] and row["key"] and r["scope"] == scope and r["key"] == row["key"]]
        for r in replaced:
            r["live"] = False
        if idem:
            self.keys[idem] = row
        return {"row": row, "created": created, "replaced": replaced, "replay": False}


def state(df):
    return sorted((r.scope_id or "", r.content, r.canonical_key or "", r.deleted_at is None, tuple(sorted(r.tags))) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_merge_equals_whole_upsert_and_the_model(spark, seed):
    rng = random.Random(seed)
    model, whole, keys = Model(), spark.createDataFrame([], STORE), None
    for number in range(2):
        # idempotency keys are unique in a batch, and a content's key is always the same here
        rows, used = [], set()
        for c, t, s, i in random_rows(rng, 14):
            t = ["canonical"] if c.startswith("Favorite") else t
            rows.append((c, t, s, None if i in used else i))
            used.add(i)
        writes = batch(spark, rows, 100 * number).withColumn("seq", F.col("seq") + 1000 * number)
        done = merge.write(whole, writes, keys)
        told = {r.seq - 1000 * number: r for r in done.outcome.collect()}
        after = spark.createDataFrame(done.store(whole).collect(), done.rows.schema)
        bound = {r.key: r.memory_id for r in done.keys.collect()}
        by_id = {r.id: r for r in after.collect()}
        assert len(by_id) == after.count()
        for k, (c, t, s, i) in enumerate(rows):
            want, got = model.write(c, t, s, i), told[k]
            assert (got.created, got.replay) == (want["created"], want["replay"]), (number, k)
            assert by_id[got.id].content == c
            assert sorted(by_id[x].content for x in got.replaced_ids) == sorted(r["content"] for r in want["replaced"]), (number, k)
        assert {k: by_id[m].content for k, m in bound.items()} == {k: r["content"] for k, r in model.keys.items()}
        assert sorted((r["scope"] or "", r["content"], r["key"] or "", r["live"], tuple(sorted(r["tags"]))) for r in model.rows) == state(after)
        fresh = writes.join(done.outcome.where("replay").select("seq"), "seq", "left_anti")
        assert state(ingest.upsert(whole, fresh)) == state(after)
        whole, keys = after, spark.createDataFrame(done.keys.collect(), done.keys.schema)


def test_a_small_batch_leaves_most_rows_alone(spark):
    store = ingest.upsert(spark.createDataFrame([], STORE), batch(spark, [(f"note {k}", [], f"s{k % 3}", None) for k in range(300)] + [(f"Favorite {k}: a", ["canonical"], None, None) for k in range(50)]))
    store = spark.createDataFrame(store.collect(), store.schema)
    done = merge.write(store, batch(spark, [("note 7", [], "s1", None), ("Favorite 3: b", ["canonical"], None, None), ("new", [], None, None)], 500).withColumn("seq", F.col("seq") + 1000))
    assert done.touched.count() == 2
    assert sorted(r.content for r in done.rows.collect()) == ["Favorite 3: a", "Favorite 3: b", "new", "note 7"]
    assert done.store(store).count() == 352
    plan = done.store(store)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_metadata_survive_merges(spark):
    meta = lambda df, **m: df.withColumn("metadata", F.create_map(*(F.lit(x) for kv in m.items() for x in kv)))
    one = merge.write(spark.createDataFrame([], STORE), meta(batch(spark, [("note", [], None, None)]), a="1", b="1")).store(spark.createDataFrame([], STORE))
    two = merge.write(one, meta(batch(spark, [("note", [], None, None)], 5).withColumn("seq", F.col("seq") + 9), b="2", c="2")).store(one)
    assert two.first().metadata == {"a": "1", "b": "2", "c": "2"}


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def contents(df):
    return sorted(r.content for r in df.where("deleted_at is null").collect())


def test_versions_are_undisturbed_and_parts_are_shared(spark, store):
    one = store.write(batch(spark, [(f"note {k}", [], None, None) for k in range(40)]))
    reader = store.memories(one)
    two = store.write(batch(spark, [("note 3", ["more"], None, None), ("Favorite x: a", ["canonical"], "s1", "k")]))
    changed = {p for p, f in two.parts["memories"].items() if one.parts["memories"].get(p) != f}
    assert len(changed) == 2 and len(two.parts["memories"]) > 2
    assert reader.count() == 40 and store.memories(one).where("size(tags) > 0").count() == 0
    assert store.memories(two).count() == 41
    told = {r.seq: r for r in store.outcome(two).collect()}
    assert not told[0].created and told[1].created and store.keys(two).first().memory_id == told[1].id
    again = store.write(batch(spark, [("Favorite x: a", ["canonical"], "s1", "k")]))
    assert store.outcome(again).first().replay and store.memories(again).count() == 41


def test_scopes_open_their_parts_only(spark, store):
    from tesserae.plans.scope import Scope

    store.write(batch(spark, [("g", [], None, None), ("s", [], "s1", None)]))
    found = store.memories(scopes=[Scope("session", "s1")])
    assert contents(found) == ["s"] and all("_part=session-" in f for f in found.inputFiles())
    assert store.memories(scopes=[]).count() == 0


def test_a_writer_that_dies_leaves_the_version(spark, store, monkeypatch):
    store.write(batch(spark, [("a", [], None, None)]))
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.write(batch(spark, [("b", [], None, None)]))
    assert contents(store.memories()) == ["a"] and store.versions() == [1]
    store.write(batch(spark, [("c", [], None, None)]))
    assert store.vacuum(keep=1) >= 1
    assert contents(store.memories()) == ["a", "c"] and store.versions() == [2]


def test_two_writers_at_once_both_count(spark, store, monkeypatch):
    store.write(batch(spark, [("a", [], None, None)]))
    merged, raced = Store._merged, []

    def slow(self, before, rows, batches):
        made = merged(self, before, rows, batches)
        if not raced:
            raced.append(True)
            raced.append(Store(spark, self.root, 8).write(batch(spark, [("other", [], None, None), ("Favorite x: a", ["canonical"], None, None)])))
        return made

    monkeypatch.setattr(Store, "_merged", slow)
    with pytest.raises(Conflict):
        store.commit(store.snapshot())
    last = store.write(batch(spark, [("mine", [], None, None), ("Favorite x: b", ["canonical"], None, None)]))
    assert last.version == 3 and contents(store.memories()) == ["Favorite x: b", "a", "mine", "other"]


def test_ids_stay_apart_over_many_versions(spark, store):
    for value in "ababa":
        store.write(batch(spark, [(f"Favorite x: {value}", ["canonical"], None, None)]))
    rows = store.memories().collect()
    assert len(rows) == 5 == len({r.id for r in rows}) and contents(store.memories()) == ["Favorite x: a"]


def test_a_stream_that_is_sent_twice_counts_once(spark, store, tmp_path):
    source = str(tmp_path / "source")
    batch(spark, [("a", [], None, "k1"), ("b", [], None, None)]).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(source)
    crashed = []

    class Crashing(Store):
        def write(self, *args):
            made = super().write(*args)
            if not crashed:
                crashed.append(made)
                raise RuntimeError("the driver dies after the version is made, before the stream knows")
            return made

    with pytest.raises(Exception, match="driver dies"):
        into_store(stream(), Crashing(spark, store.root, 8), "notes", str(tmp_path / "check")).awaitTermination()
    assert store.snapshot().version == 1
    into_store(stream(), store, "notes", str(tmp_path / "check")).awaitTermination()
    assert store.snapshot().version == 1 and contents(store.memories()) == ["a", "b"]
    batch(spark, [("c", [], None, None)], 9).coalesce(1).write.mode("append").parquet(source)
    into_store(stream(), store, "notes", str(tmp_path / "check")).awaitTermination()
    assert store.snapshot().batches == {"notes": 1} and contents(store.memories()) == ["a", "b", "c"]


# --- the index of terms --------------------------------------------------------------------------------------------


def same_candidates(store, query, scopes, now):
    from tesserae.operators import lexical
    from tesserae.plans.scope import active, in_scope

    rows = store.memories()
    want = lexical.candidates(rows.where("deleted_at is null"), query, where=in_scope(scopes) & active(now)).collect()
    got = store.candidates(query, scopes, now).collect()
    assert [(r.id, round(r.bm25, 9)) for r in got] == [(r.id, round(r.bm25, 9)) for r in want]
    return got


def test_index_equals_the_scan_over_versions(spark, store, monkeypatch):
    from tesserae.plans.scope import Scope
    from tesserae.sources import store as module

    monkeypatch.setattr(module, "GENERATIONS", 2)
    everywhere = [Scope("global"), Scope("session", "*")]
    texts = ["alpha beta beta", "Beta_gamma delta", "beta gamma", "gamma beta", "Élan alpha", "", "delta " * 30 + "alpha"]
    for k in range(3):
        rows = [(f"{t} {k}" if t else "", [], s, None) for t in texts for s in (None, "s1")]
        store.write(batch(spark, [*rows, (f"Favorite alpha: beta {k}", ["canonical"], None, None)], 50 * k))
        for query in ("alpha beta", "beta_gamma", "elan", "") if k < 2 else ("alpha beta", "nothing", "delta 1 2"):
            same_candidates(store, query, everywhere, T0)
        same_candidates(store, "alpha beta", [Scope("session", "s1")], T0)
    now = store.snapshot()
    assert len(now.terms) <= 2 and now.n_gone < 2
    best = store.search("favorite alpha", everywhere, T0, limit=50).collect()
    assert "Favorite alpha: beta 2" in {r.content for r in best} and not {"Favorite alpha: beta 0", "Favorite alpha: beta 1"} & {r.content for r in best}


def test_expired_rows_make_room_for_others(spark, store, monkeypatch):
    from tesserae.plans.scope import Scope

    rows = batch(spark, [(f"alpha {'x ' * (k % 5)}{k}", [], None, None) for k in range(30)]).withColumn("ttl_days", F.when(F.col("seq") % 3 == 0, 400).otherwise(1))
    store.write(rows)
    assert len(store.candidates("alpha", [Scope("global")], T0 + timedelta(days=2), limit=2).collect()) == 2
    assert len(same_candidates(store, "alpha", [Scope("global")], T0 + timedelta(days=2))) == 10


def test_a_search_opens_its_terms_folders_only(spark, store):
    store.write(batch(spark, [(" ".join(f"word{k}x{j}" for j in range(40)), [], None, None) for k in range(20)]))
    snapshot = store.snapshot()
    files = store._postings(snapshot).inputFiles()
    few = store.scored("word3x7").inputFiles()
    assert 0 < len(few) <= 4 < len(files) and store.scored("word3x7").count() == 1
    plan = store.scored("word3x7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,word3x7)" in plan


def test_shown_rows_are_noted_beside_the_store(spark, store, monkeypatch):
    from tesserae.sources import store as module

    monkeypatch.setattr(module, "GENERATIONS", 2)
    one = store.write(batch(spark, [("a", [], None, None), ("b", [], None, None), ("c", [], None, None)]))
    ids = {r.content: r.id for r in store.memories().collect()}
    shown = lambda *names: spark.createDataFrame([(ids[n],) for n in names], "id string")
    assert store.accessed().count() == 0
    for k, names in enumerate(("ab", "b", "bc", "c")):
        last = store.touch(shown(*names), T0 + timedelta(hours=k))
    assert last.parts == one.parts and len(last.accessed) <= 2  # no row was written again
    assert {r.id: r.last_accessed_at for r in store.accessed().collect()} == {ids["a"]: T0, ids["b"]: T0 + timedelta(hours=2), ids["c"]: T0 + timedelta(hours=3)}
    store.write(batch(spark, [("d", [], None, None)]))
    store.vacuum(keep=1)
    assert store.accessed().count() == 3 and store.memories().count() == 4


def test_the_index_holds_numbers_for_ids(spark, store, tmp_path):
    """A posting takes some bytes, not an id of 64 letters, and what a number stands for is looked up in the ranges of hits only."""
    from tesserae.operators import postings

    rng = random.Random(5)
    store.write(batch(spark, [(" ".join(rng.choices([f"word{j}" for j in range(900)], k=80)), [], f"s{k % 3}", None) for k in range(600)]))
    now = store.snapshot()
    files = [p for g in now.terms for f in g.values() for p in (tmp_path / "store").glob(f"{f.partition('/store/')[2]}/*.parquet")]
    n = postings.unpacked(store._postings(now)).count()
    assert n > 40_000 and sum(p.stat().st_size for p in files) < 20 * n
    assert store._numbers(now).count() == now.n_rows == 600 and now.n_tokens == 48_000


def test_tokens_of_long_rows_are_cut_between_rows(spark, monkeypatch):
    from tesserae.operators import postings

    monkeypatch.setattr(postings, "TOKENS", 10)
    rows = spark.createDataFrame([(9 - k, " ".join(f"w{j % 4}" for j in range(n))) for k, n in enumerate((3, 25, 0, 6, 4, 1))], "id long, content string").coalesce(1)
    blocks = postings.packed(rows)
    got = {(r.id, r.term): (r.n, r.positions) for r in postings.unpacked(blocks).collect()}
    assert got == {(9 - k, f"w{j}"): (n, list(range(j, n, 4))) for k, n in enumerate((3, 25, 0, 6, 4, 1)) for j in range(min(n, 4))}
    again = {(r.id, r.term): (r.n, r.positions) for r in postings.unpacked(postings.repacked(postings.unpacked(blocks))).collect()}
    assert again == got and blocks.agg(F.sum("places")).first()[0] == 39


# --- what a write costs --------------------------------------------------------------------------------------------


def test_a_write_leaves_stored_rows_where_they_are(spark, store, tmp_path):
    store.write(batch(spark, [(f"note {k}", [], f"s{k % 3}", None) for k in range(60)]))
    two = store.write(batch(spark, [("note 7", ["more"], "s1", None), ("new", [], None, None)]))
    own = [f for fs in two.parts["memories"].values() for f in fs if f"/data/{2:012d}-" in f]
    assert contents(spark.read.parquet(*own).withColumn("deleted_at", F.lit(None))) == ["new", "note 7"]
    assert store.memories(two).count() == 61 and store.memories(two).where("content = 'note 7'").first().tags == ["more"]
    assert not list((tmp_path / "store" / "data").glob("*/draft"))  # contents that were put aside meanwhile


def test_folders_and_stale_rows_stay_few(spark, store, monkeypatch):
    """Over many writes that touch the same rows and others, with few folders a part and few stale rows a part and in all."""
    from tesserae.sources import store as module

    monkeypatch.setattr(module, "GENERATIONS", 2)
    want = {}
    for k in range(5):
        monkeypatch.setattr(ingest, "MOST_BROADCAST", 24 if k == 3 else 500_000)  # one row a part
        rows = [("a", [f"t{k}"], None, None), (f"b{k % 2}", [f"t{k}"], "s1", None), (f"c{k}", [f"t{k}"], "s1", None), (f"Favorite x: {k}", ["canonical"], None, None)]
        now = store.write(batch(spark, rows, 100 * k))
        for content, tags, *_ in rows:
            want[content] = [*want.get(content, []), *tags]
        assert {r.content: r.tags for r in store.memories(now).collect()} == want
        assert store.memories(now).count() == len(want) and store.memories(now).where("deleted_at is not null").count() == k
        assert len(now.stale) <= 2 and max(map(len, now.parts["memories"].values())) <= 3
        assert sum(now.n_stale.values()) <= now.n_listed
    assert contents(store.memories(store.snapshot(4))) == sorted(["a", "b0", "b1", "c0", "c1", "c2", "c3", "Favorite x: 3"])


def test_contents_are_redacted_once_and_move_once(spark):
    rows = [("same " * 50, [], None, None)] * 6 + [("other " * 50, [], "s1", None), ("  ", [], None, None)]
    ready = ingest.normalized(batch(spark, rows).repartition(3))
    assert ready._jdf.queryExecution().optimizedPlan().toString().count("Bearer") == 1
    live, fresh, columns = ingest._aligned(spark.createDataFrame([], STORE), ready.localCheckpoint())
    _, merged = ingest.versions(live, fresh, columns)
    got = ingest.dealt(merged, live, fresh, {"_part": F.xxhash64("content_hash") % 2})
    want = ingest.filled(merged, live, fresh)
    assert sorted(got.select(columns).collect(), key=lambda r: r.id) == sorted(want.select(columns).collect(), key=lambda r: r.id)
    moves = [x for x in got._jdf.queryExecution().executedPlan().toString().split("Exchange ")[1:] if "_part" in x.split("\n")[0]]
    assert len(moves) == 1 and got.count() == 2
