"""Quality rules, near-dedup, personal data and mixing against brute-force versions."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import common, components, golay, mixing, pii, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df):
    return df.collect()


# --- quality -------------------------------------------------------------------------------------------------------


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = Counter(windows)
    inside = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_base_rules_on_every_text(spark, docs):
    model = quality.QualityModel((0.0,) * 16, float("-inf"), 60.0)
    rows = quality.judge(docs, model).select("text", f"{quality.VERDICT}.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == base_rules(r["text"]) and r["kept"] == (not r["base_failed"])


def test_repeats_on_random_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 2) + " # | x" for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df, quality.QualityModel((0.0,) * 16, 0.0, 1.0)).collect():
        assert r[quality.VERDICT]["n_repeat_words"] == base_rules(r["text"])[4]


def test_score_is_the_log_likelihood_ratio(spark):
    rng = random.Random(5)
    good, bad = ["the", "of", "and", "to"], ["###", "$$$", "buy!!"]
    texts = [" ".join(rng.choice(good if k % 4 else good + bad * 3) for _ in range(40)) for k in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = quality.fit(df, df.where("doc_id % 4 <> 0").select("doc_id"), buckets=64)
    rows = quality.judge(df, model).select("doc_id", "text", f"{quality.VERDICT}.score", f"{quality.VERDICT}.kept").collect()
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in good + bad], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame([(hashes[a], hashes[b]) for a in hashes for b in hashes], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for r in rows[:40]:
        h = [hashes[w] for w in r["text"].split()]
        grams = [x % 64 for x in h] + [pairs[x] % 64 for x in zip(h, h[1:])]
        assert r["score"] == pytest.approx(sum(model.weights[g] for g in grams) / (len(grams) + model.shrink), abs=1e-4)
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len([k for k in range(200) if k % 4 and k not in kept]) <= 3 and len([k for k in range(0, 200, 4) if k in kept]) <= 5


def test_quality_of_nothing(spark, docs):
    none = docs.limit(0)
    model = quality.fit(none, none.select("doc_id"))
    assert quality.judge(none, model).count() == 0 and set(model.weights) == {0.0}
    assert quality.fit(docs, docs.limit(0).select("doc_id"), buckets=8).weights == (0.0,) * 8


# --- near-dedup ----------------------------------------------------------------------------------------------------


def test_golay_tables():
    g, rng = golay.Golay(), np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000).astype(np.uint32)
    y = x ^ (1 << rng.integers(0, 23, 4000)).astype(np.uint32)
    assert (g.near(x) == g.nearest(y)[:, None]).any(1).all() and (g.near(y) == g.nearest(x)[:, None]).any(1).all()
    assert {int(c).bit_count() for c in (g.error)} == {0, 1, 2, 3} and len(set(g.error.tolist())) == 2048


def plain_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_groups(rows):
    """component of each row by comparing all fingerprints."""
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                group[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for f in fps}


def test_components_of_texts(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = expected_groups([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows])
    got = simhash.components(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((str(r["doc_id"]), f"{(f := plain_fingerprint(r['text'])):016x}", want[f]) for r in rows)
    assert spark.createDataFrame([("a b c d",)], "g string").select(F.xxhash64("g")).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).astype(np.int64)


def test_links_lose_nothing(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(20):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
    check_groups(spark, fps)


def check_groups(spark, fps):
    """Groups of the operator against those by comparing all fingerprints."""
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    root = {r["u"]: r["root"] for r in simhash.linked(spark.createDataFrame([(f,) for f in signed.values()], "fp long")).collect()}
    want = expected_groups(list(enumerate(sorted(fps))))
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(root.get(signed[f], signed[f]))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups) > 1


@pytest.mark.parametrize("hot", [100, 3])
def test_large_groups_of_near_copies(spark, monkeypatch, hot):
    """Many fingerprints in the same buckets, in components that only pairs away from a bucket's first can join; also with hot keys and small blocks."""
    for of in (common, simhash):
        monkeypatch.setattr(of, "LEAST_HOT", hot)
    for of in (components, simhash):
        monkeypatch.setattr(of, "BLOCK", 7)
    if hot == 3:
        monkeypatch.setattr(components, "SMALL", 0)
    rng = random.Random(3)
    low = rng.getrandbits(22)
    fps = {low | rng.getrandbits(42) << 22 for _ in range(30)}  # one bucket, nothing near
    for f in list(fps)[:6]:
        for _ in range(12):
            fps.add(f ^ 1 << rng.randrange(22, 64) ^ 1 << rng.randrange(22, 64))
    chain = rng.getrandbits(64)
    for _ in range(60):
        fps.add(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
    check_groups(spark, fps)


def test_simhash_keys_join_all_links():
    """Of every pair within four bits some key is shared, by opposite sides or by a segment."""
    rng = random.Random(12)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4)))
        rows, found, sides = simhash.keys(np.array([a, b], np.uint64))
        of = [{(k, s) for r, k, s in zip(rows.tolist(), found.tolist(), sides.tolist()) if r == i} for i in (0, 1)]
        assert any((k, 2 if s == 2 else 1 - s) in of[1] for k, s in of[0])


def test_components_of_long_paths_and_nothing(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    roots = {r["u"]: r["root"] for r in components.roots(edges).collect()}
    assert roots == {k: 0 for k in range(1, n + 1)} | {1001: 1000}
    assert components.roots(edges.limit(0)).count() == 0
    assert simhash.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in simhash.components(docs).where("doc_id is not null").collect()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(groups) + Counter([None])


# --- personal data -------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice("012345@@..+- ()aé%9") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)
    pii.base_spans("1" * 200_000 + "@" * 20_000 + "a" * 200_000)  # in linear time


def other_sentences(rng):
    """Sentences of another make than the training's: real words, names, other layouts and other numbers."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    names, hosts = ["anna", "Li.Wei", "j.o-neil", "PaulaK", "sven_h", "maria99", "r2d2", "info", "no-reply"], ["example.com", "Uni-Jena.de", "mx3.shop.co.nz", "some.gov.uk", "a1.io", "kyoto-u.ac.jp"]

    def card():
        head = rng.choice(["4", "51", "55", "37", "6011"])
        size = 15 if head == "37" else 16
        body = head + n(size - 1 - len(head))
        body += next(c for c in "0123456789" if pii.luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        cuts = (0, 4, 10, 15) if size == 15 else (0, 4, 8, 12, 16)
        return sep.join(body[a:b] for a, b in zip(cuts, cuts[1:]))

    kinds = (
        lambda: rng.choice(names) + rng.choice(["@", "@", " @ ", "@ "]) + rng.choice(hosts),
        lambda: f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}",
        card,
        lambda: rng.choice([f"+1 {n(3)} {n(3)} {n(4)}", f"+44 20 {n(4)} {n(4)}", f"(0{n(2)}) {n(4)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"{n(3)} {n(3)} {n(4)}", f"1-{n(3)}-{n(3)}-{n(4)}"]),
    )
    lead = (["Write to ", "Ask ", "mail: ", "reach me under ", "Cc "], ["Server ", "from ", "ping ", "host ", "deny "], ["charged to ", "card no. ", "Visa ", "paid with "], ["Ring ", "call ", "Tel. ", "our number is ", "Fax: "])
    none = (
        lambda: f"on {rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(10, 23)}:{n(2)}", lambda: f"ISBN 978-3-{n(4)}-{n(4)}-{n(1)}", lambda: f"ISBN-10 0-{n(3)}-{n(5)}-{n(1)}", lambda: f"order {n(3)}-{n(7)}-{n(7)}",
        lambda: f"invoice {n(8)}", lambda: f"a total of {n(1)},{n(3)},{n(3)}.{n(2)} euros", lambda: f"from {rng.randint(1900, 1990)} to {rng.randint(1991, 2020)}", lambda: f"at {n(2)}.{n(6)}, {n(2)}.{n(6)}", lambda: f"doi 10.{n(4)}/j.{n(6)}", lambda: f"step {n(1)} of {n(2)}",
        lambda: f"pages {n(3)}-{n(3)}", lambda: f"released as v{n(1)}.{n(2)}.{n(1)}", lambda: f"lunch @ {n(1)}.30", lambda: f"thanks @{rng.choice(names)}", lambda: f"id {n(10)}", lambda: f"in {rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2029)}", lambda: f"scores {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"hash {rng.randrange(1 << 128):032x}",
    )
    text, spans = "", []
    for _ in range(rng.randint(1, 4)):
        text += rng.choice(["Yes, ", "For the record, ", "The note says: ", "However ", ""])
        if rng.random() < 0.6:
            k = rng.randrange(4)
            text += rng.choice(lead[k])
            s = kinds[k]()
            spans.append((len(text), k, len(text) + len(s)))
        else:
            s = rng.choice(none)()
        text += s + rng.choice([". ", ", ", "\n", " and then ", "; ", "! "])
    return text, spans


@pytest.mark.parametrize("make", [pii.made, other_sentences])
def test_field_on_held_out_sentences(make):
    """Precision and recall of the field alone, without the base patterns, for each kind."""
    field, rng = pii.trained(), random.Random(77)
    right, found, true = Counter(), Counter(), Counter()
    for _ in range(600):
        text, spans = make(rng)
        got = {s for run in pii.runs(text) for s in field.decode(run)}
        for count, of in ((right, got & set(spans)), (found, got), (true, spans)):
            count.update(s[1] for s in of)
    for k, name in enumerate(pii.KINDS):
        assert right[k] >= 0.9 * found[k] and right[k] >= 0.9 * true[k] and true[k] > 100, name


@pytest.mark.parametrize("text, want", [
    ("write to foo_bar @ baz.org now", ["email:foo_bar @ baz.org"]), ("call 5551234567.", ["phone:5551234567"]), ("电话5551234567请", ["phone:5551234567"]),
    ("order 2024-01-02 10:33", []), ("on 02.01.2024 10:33 h", []), ("ISBN 978-3-16-148410-0", []), ("order 123-4567890-1234567", []), ("lunch @ 4pm @anna", []), ("call  (415)  555-0199", ["phone:(415)  555-0199"]), ("(415) 555-0199", ["phone:(415) 555-0199"]),
    ("a.b@c.de, 4111 1111 1111 1111", ["email:a.b@c.de", "card:4111 1111 1111 1111"]),
])
def test_spans_of_examples(text, want):
    assert [f"{pii.KINDS[k]}:{text[a:b]}" for a, k, b in pii.all_spans(text, pii.trained())[1]] == want


def test_long_texts_take_linear_time():
    field = pii.trained()
    for part, n in (("a.b@c.example.org,", 55_000), ("a_b @ c.org ", 20_000), ("1-", 100_000), ("12 345 6 78 9 ", 10_000), ("a1b2c3d4", 30_000), ("x@y", 100_000), ("电话5551234567", 10_000)):
        began = time.process_time()
        base, every = pii.all_spans(part * n, field)
        assert time.process_time() - began < 5, part
        assert all(a[2] <= b[0] for a, b in zip(every, every[1:])) and set(base) <= set(every)


def test_decode_is_the_best_segmentation():
    field = pii.trained()
    run = next(pii.runs("call (415) 555-0199 9"))
    scores = {(i, i + 1, 0): field.other for i in range(len(run.at))} | {(i, j, y): s for i, starts in enumerate(run.starts) for j, key in starts for y, s in enumerate(field.scores(key), 1)}
    steps = field.steps

    def best(at, prev):
        if at == len(run.at):
            return 0.0, []
        options = [(s + steps[prev, y] + (rest := best(j, y))[0], [(i, j, y)] * (y > 0) + rest[1]) for (i, j, y), s in scores.items() if i == at]
        return max(options, key=lambda o: o[0])

    assert [(run.at[i][0], y - 1, run.at[j - 1][1]) for i, j, y in best(0, 0)[1]] == field.decode(run)


def test_find_and_redact(spark, docs):
    got = {(r["doc_id"], r["spans"]): r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for (doc_id, spans), r in got.items():
        base = plain_spans(texts[doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= set(spans.split(",")) | {""}
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[14]["text"].startswith("mail me: [EMAIL] or [PHONE], card [CARD] at [IP]") and clean[14]["n_chars"] == len(clean[14]["text"])
    assert "[PHONE]" in clean[15]["text"] and clean[0]["text"] is None and clean[9]["text"] == texts[9] and clean[1 << 60]["n_chars"] is None or clean[1 << 60]["n_chars"] == 8
    assert pii.redact(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 100, None: 100}, 300)
    assert got == pytest.approx({"a": 50, "b": 100, None: 150})
    capped = mixing.targets({"a": 1000, "b": 10, "c": 10}, 1020)
    assert capped == pytest.approx({"a": 960, "b": 30, "c": 30})
    assert mixing.targets({}, 0) == {} and mixing.targets({"a": 0}, 0) == {"a": 0}


def cheapest(capacity, members, quota, repeats):
    """Cost and size of the best flow, by trying everything word by word."""
    best = {}
    arcs = sorted((p, s) for p in members for s in members[p])

    def go(k, flow):
        if k == len(arcs):
            used, filled = Counter(), Counter()
            for (p, s), f in flow.items():
                used[p] += f
                filled[s] += f
            if all(used[p] <= repeats * capacity[p] for p in used) and all(filled[s] <= quota[s] for s in filled):
                cost = sum(sum(min(max(0, used[p] - r * capacity[p]), capacity[p]) * r for r in range(repeats)) for p in used)
                size = sum(flow.values())
                best[size] = min(cost, best.get(size, cost))
            return
        for f in range(quota[arcs[k][1]] + 1):
            go(k + 1, flow | {arcs[k]: f})

    go(0, {})
    return max(best), best[max(best)]


def test_flow_is_cheapest():
    rng = random.Random(6)
    for _ in range(25):
        members = {p: tuple(s for s in "ab" if s in p) for p in ("a", "b", "ab")}
        capacity, quota = {p: rng.randint(0, 3) for p in members}, {s: rng.randint(0, 6) for s in "ab"}
        flow = mixing.min_cost_flow(capacity, members, quota)
        used = Counter()
        for (p, _), f in flow.items():
            used[p] += f
        cost = sum(sum(min(max(0, used[p] - r * capacity[p]), capacity[p]) * r for r in range(3)) for p in used)
        assert (sum(flow.values()), cost) == cheapest(capacity, members, quota, 3)


def test_mix_of_documents(spark, docs):
    taken, plan = mixing.mix(docs, F.array("source"))
    rows = taken.collect()
    assert len(rows) == docs.count() and sum(r["size"] for r in rows) == sum(len(WORD.findall(r["text"] or "")) for r in docs.select("text").collect())
    for source, target in plan.targets.items():
        mine = [r for r in rows if r["sources"][0] == source]
        assert sum(r["size"] for r in mine) == plan.sizes[source] and abs(sum(r["taken"] for r in mine) - target) <= 1 and target <= 3 * plan.sizes[source] + 1e-9
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(5), F.array("source"))[0]
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))
    assert mixing.mix(docs.limit(0), F.array("source"))[0].count() == 0


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, ["a", "b"] if k % 2 else ["a"]) for k in range(40)], "doc_id long, text string, src array<string>")
    taken, plan = mixing.mix(df, F.col("src"), weights=(1, 1))
    assert sum(r["taken"] for r in taken.collect()) == pytest.approx(sum(plan.targets.values()), abs=2)
    odd = [(1, "w w", ["a", "b", "a"]), (2, "w", ["b", "a"]), (3, "w w w", None), (4, "w", []), (5, "w", [None, None])]
    odd_taken, odd_plan = mixing.mix(spark.createDataFrame(odd, "doc_id long, text string, src array<string>"), F.col("src"))
    assert odd_plan.sizes == {"a": 3, "b": 3, None: 1} and {r["doc_id"]: r["taken"] for r in odd_taken.collect()}.keys() == {1, 2, 3, 4, 5}
    assert all(r["taken"] == 0 for r in odd_taken.where("doc_id in (3, 4)").collect())
    with pytest.raises(ValueError):
        mixing.plan(spark.range(mixing.MAX_PATTERNS + 1).select(F.lit(1).alias("size"), F.array(F.col("id").cast("string")).alias("sources")))


def test_applied_mix_repeats_documents(spark, docs):
    out = mixing.apply(docs, F.array("source"))
    assert out.columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    rows = Counter(r["doc_id"] for r in docs.collect())
    assert all(n <= 3 * rows[k] for k, n in counts.items())
