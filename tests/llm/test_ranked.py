"""Byte-level BPE, ranked lexical search and hard negatives against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, lexrank, negatives, queries

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


# --- byte-level BPE ------------------------------------------------------------------------------------------------


def test_digests_equal_the_library(docs, library):
    rows = [tuple(r) for r in byte_bpe.digests(docs, PATH).collect()]
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(r.text or "")))
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_fold_equals_the_library_on_words(spark, library):
    rng = random.Random(3)
    found = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoin shrdlu", "aé漢😀\x00 ") for n in (1, 2, 3, 7, 20, 40) for _ in range(8)]
    merges = byte_bpe.literal_map(byte_bpe.merges_of(PATH).items())
    rows = spark.createDataFrame([(w,) for w in found], "w string").select("w", byte_bpe.let(merges, lambda m: byte_bpe.folded(F.col("w"), m, PATH)).alias("l")).collect()
    for r in rows:
        assert [ord(c) - byte_bpe.FIRST for c in r.l] == library._core_bpe.encode_single_piece(r.w.encode())


def test_words_and_queue_on_long_words(library):
    rng = random.Random(4)
    for n in (1, 2, 60, 95, 96, 97, 400, 20_000):
        for letters in (b"ab", b"abcdefgh", bytes(range(256))):
            word = bytes(rng.choice(letters) for _ in range(n))
            assert byte_bpe.encode_word(word, byte_bpe.ranks_of(PATH)) == library._core_bpe.encode_single_piece(word)


def test_every_code_point_is_cut_as_the_library_does(spark, library):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(f"{c}a{c}{c}1{c} " for c in points[k : k + 700]) for k in range(0, len(points), 700)]
    rows = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert len(rows) == len(texts)
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in rows)


def test_results_do_not_depend_on_the_known_words(spark, docs, monkeypatch):
    whole = {(r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(docs, PATH).collect()}
    monkeypatch.setattr(byte_bpe, "frequent_words", lambda *_: byte_bpe.literal_map([]))
    assert {(r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(docs, PATH).collect()} == whole


def test_decode_of_unknown_ids_and_empty_tables(spark, docs):
    row = spark.sql("select array(1, null, -5, 50300, 2) as ids").select(byte_bpe.decoded(F.col("ids"), PATH).alias("b")).first()
    ranks = {r: t for t, r in byte_bpe.ranks_of(PATH).items()}
    assert bytes(row.b) == ranks[1] + ranks[2]
    assert byte_bpe.digests(docs.limit(0), PATH).collect() == []


# --- ranked lexical search -----------------------------------------------------------------------------------------


def terms(text):
    return [t.translate({k: k + 32 for k in range(65, 91)}) for t in TERM.findall(text or "")]


def ranked(docs, items, limit=20):
    """Brute force over lists of (doc_id, text) and (item_id, text)."""
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, query in asked.items():
        scored = []
        for place, (d, c, n) in enumerate(found):
            m = 100 - 25 + ((25 * n * n_docs) // total)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scored.append((-score, -1 if d is None else d, place, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=repr)


ITEMS = [(0, "alpha BETA gamma"), (1, "ÉTA θeta"), (2, None), (3, "nothing_of these"), (4, "alpha alpha"), (4, "kappa"), (None, "iota x"), (5, " \n"), (6, "zeta " * 40)]


def test_search_equals_brute_force(spark, docs):
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, n long, term string")
    rows = [tuple(r) for r in lexrank.search(docs, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(rows, key=repr) == ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_search_without_broadcast_is_the_same(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexrank, "MOST_BROADCAST", 0)
    rows = [tuple(r) for r in lexrank.search(docs, items, limit=7).collect()]
    assert sorted(rows, key=repr) == ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 7)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexrank.search(docs.limit(0), items).collect() == []
    assert lexrank.search(docs, items.limit(0)).collect() == []


def test_postings_of_few_terms_open_few_buckets(spark, docs, tmp_path):
    path = f"file://{tmp_path}/postings"
    lexrank.write_postings(docs, path)
    postings = lexrank.read(spark, path)
    asked = lexrank.asked_terms(spark.createDataFrame([(1, "kappa")], "item_id long, text string"))
    plan = lexrank.top(postings, asked, *lexrank.statistics(postings))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"bucket#\d+ IN \(\d+\)|bucket#\d+ = \d+", plan)


# --- hard negatives ------------------------------------------------------------------------------------------------


def mined(rows, positives=5, kept=3):
    rows = sorted(((v, label, np.floor(256 * np.array(x, np.float64)).astype(np.int64)) for v, x, label in rows), key=lambda r: r[0])
    ids, labels, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.stack([r[2] for r in rows])
    out = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = q @ q[k]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if labels[j] == labels[k] and j != k][:positives]:
            hits = [j for j in order if labels[j] != labels[k] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:kept]
            out += [tuple(map(int, (ids[k], ids[p], r + 1, ids[j], s[p], s[j]))) for r, j in enumerate(hits)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("blocks", [(1024, 256), (32, 4)])
@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_mining_equals_brute_force(spark, monkeypatch, blocks, kind):
    monkeypatch.setattr(negatives, "BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rng = np.random.default_rng(5)
    n = 900
    if kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 16))
    else:
        x = rng.normal(size=(n, 16))
    if kind == "copies":
        x[: n // 3] = x[0]
    rows = [(int(v), [float(c) for c in x[v]], int(v * 7 % 4)) for v in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = negatives.mine(negatives.prepared(df), F.col("id") % 50 == 0)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == mined(rows)


def test_nodes_out_of_reach_are_dropped():
    """Two far clusters in one tree: a walk of anchors of the one for scores near their own finds no leaf of the other."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(400, 8)) * 0.1 + 50, rng.normal(size=(400, 8)) * 0.1 - 50])
    tree = negatives.Tree.fit(x, 3)
    leaf = tree.leaves(x)
    radii = np.full(15, -1.0)
    for level in range(4):
        for row, at in zip(x, leaf):
            node = (1 << level) - 1 + (at >> (3 - level))
            radii[node] = max(radii[node], np.linalg.norm(row - tree.centres[node]))
    blocks = negatives.Blocks(None, 3, radii, None)
    pairs = negatives.walk(tree, blocks, blocks, np.full(15, 19_000.0), np.full(15, np.inf))
    assert len(pairs) == 32
    for i, j in pairs:
        assert (i < 4) == (j < 4)


def test_rows_that_take_no_part(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (1, v, 1), (2, [0.45, 0.2], 2), (2, [0.45, 0.2], 2), (3, None, 1), (4, v, None), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 2), (None, v, 2), (8, [float("inf"), 0.0], 2), (9, [0.4], 2), (9, [0.4], 3), (10, [], 2)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<float>, label int, score long, id long")
    found = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(negatives.prepared(df), F.col("id") % 50 == 0).collect())
    want = mined([(0, v, 1), (1, v, 1), (2, [np.float32(0.45), np.float32(0.2)], 2), (9, [np.float32(0.4), 0.0], 2), (10, [0.0, 0.0], 2)])
    assert found == want and found
    assert negatives.mine(negatives.prepared(df.limit(0)), F.col("id") % 50 == 0).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(negatives.prepared(spark.createDataFrame([(0, [1e12], 1)], "vec_id long, embedding array<double>, label int")), F.col("id") == 0)


def test_registered_queries_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    want = mined([(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_negatives(spark, d).collect()) == want
    docs, items = (spark.read.parquet(f"{d}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    found = sorted((tuple(r) for r in queries.op12_lexrank(spark, d).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert found == ranked([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert queries.op11_byte_bpe(spark, d).count() == len(docs)
