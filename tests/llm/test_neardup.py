"""The pipeline's near-dedup against a comparison of all pairs."""

import random

import corpus_pipeline
from tesserae.llm import components, neardup, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()  # A-Z, and the six ASCII separators
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def expected(rows):
    """Smallest ids of the groups of rows(doc_id, text)."""
    sets = [(d, plain_set(t)) for d, t in sorted(rows)]
    group = list(range(len(sets)))
    for k, (_, a) in enumerate(sets):
        for j in range(k):
            if len(a & sets[j][1]) >= 0.8 * len(a | sets[j][1]) and group[k] != group[j]:
                low, high = sorted((group[k], group[j]))
                group = [low if g == high else g for g in group]
    return {sets[g][0] for g in group}


def test_stage_finds_pairs_of_five_words_and_four_fifths(spark):
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 600))]
        rows.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for k in rng.sample(range(len(base)), max(1, len(base) * rng.choice([1, 2, 3, 4]) // 100)):
                copy[k] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows = [(k, t) for k, t in enumerate(rng.sample(rows, len(rows)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(expected(rows)) and 40 <= len(got) < 200


def test_near_dedup_of_odd_rows(spark, docs):
    rows = {(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").select("doc_id", "text").collect()}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [*expected(rows), None]))
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies of a copy, some of them similar to few others only, and a crowd that is near but not similar enough."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows, copies = [], [base]
    for k in range(500):
        copy = list(rng.choice(copies) if k % 3 else base)
        for j in rng.sample(range(len(copy)), rng.choice([1, 1, 2, 3, 5, 6, 8])):
            copy[j] = rng.choice(vocabulary)
        copies.append(copy)
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in neardup.deduplicate(df).collect()}
    assert got == expected(rows) and 5 < len(got) < 450


def test_own_shingles_and_sketches_leave_out_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        common, a, b = rng.integers(60, 400), rng.integers(0, 40), rng.integers(0, 40)
        pool = np.unique(rng.integers(0, 1 << 63, common + a + b, dtype=np.uint64))
        left, right = pool[: common + a], np.concatenate([pool[:common], pool[common + a :]])
        x, y = (neardup.sketch(neardup.min_hashes(s)).view(np.uint64).reshape(neardup.PLANES, -1) for s in (left, right))
        apart = int(np.bitwise_count(np.bitwise_or.reduce(x ^ y)).sum())
        if common >= 0.8 * len(pool):
            assert apart <= neardup.MAX_APART and 9 * common >= 4 * (len(left) + len(right))
        assert apart <= neardup.BANDS * neardup.ROWS and (apart == 0) == (common == len(pool))


def test_simhash_groups_are_candidates_of_their_own(spark):
    """Without any shared band, texts of a SimHash group are still found, if they are similar enough."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 900)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{k}" for k in range(400)), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = neardup.marked(df).withColumn("bands", F.array(F.xxhash64("id"))).cache()
    ids = {r["doc_id"]: r["id"] for r in rows.collect()}
    assert [set(r) for r in neardup.by_simhash(rows).collect()] == [{ids[0], ids[1]}]
    assert {x for r in neardup.links(rows, df).collect() for x in r} == {ids[0], ids[1]}


def components_of(edges):
    """(vertex, smallest vertex of its component) of all vertices but these themselves."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {(x, top(x)) for x in up if top(x) != x}


def test_rounds_over_few_edges_need_neither_joins_nor_broadcasts(spark, monkeypatch):
    """A driver keeps something of every plan; both ways find the components of chains, hubs, loops and repeated edges."""
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(1, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(7, 6), (6, 7), (5, 5)]
    edges += [(1000, k) for k in range(1001, 1300)] + [(3000 - k, 3000) for k in range(300)] + [(-5, -9), (-9, 2_000)]
    df = spark.createDataFrame(edges, "u long, v long")
    for small in (components.SMALL, 0):
        monkeypatch.setattr(components, "SMALL", small)
        assert {tuple(r) for r in components.roots(df).collect()} == components_of(edges)
    monkeypatch.undo()
    once = df.where("u <> v").localCheckpoint()
    plan = components._small_star(components._large_star(once, len(edges)), len(edges))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 3


def test_group_of_a_fingerprint_is_planned_once(spark):
    """Each plan that a join repeats is kept by the driver once more."""
    rows = spark.createDataFrame([(k, k % 7) for k in range(40)], "doc_id long, fp long")
    groups = simhash.grouped(rows)
    assert groups._jdf.queryExecution().executedPlan().toString().count("Join") <= 3  # those of one spread_join
    assert groups.count() == 40


def test_nearest_keeps_one_candidate_of_each_kind(spark):
    facts = spark.createDataFrame([(k, 100, 0, *[(1 << k) - 1 if j == 0 else 0 for j in range(neardup.PLANES * neardup.WIDE)]) for k in range(1, 6)], ["id", "size", "own", *(f"b{j}" for j in range(neardup.PLANES * neardup.WIDE))])
    pairs = spark.createDataFrame([(1, 3, 0), (1, 4, 0), (1, 5, 1), (2, 5, 1), (2, 4, 1)], "u long, v long, by int")
    assert sorted(map(tuple, neardup.nearest(pairs, facts).collect())) == [(1, 3), (1, 5), (2, 4)]
    assert sorted(map(tuple, neardup.nearest(pairs.drop("by"), facts).collect())) == [(1, 3), (2, 4)]
