"""TIFF, WARC, ORC, BPE, URLs, sharding and the pipeline."""

import base64
import hashlib
import os
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe, orc_tokens, sharding, tiff, urls, warc
from tesserae.llm.common import scratch, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


# --- TIFF ----------------------------------------------------------------------------------------------------------


def test_codecs_round_trip():
    rng = random.Random(1)
    cases = [b"", b"a", b"a" * 1000, bytes(range(256)) * 40] + [rng.randbytes(rng.randint(0, 6000)) for _ in range(20)] + [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20_000))) for _ in range(20)]
    for data in cases:
        assert tiff.unlzw(tiff.lzw(data)) == data and tiff.unpackbits(tiff.packbits(data)) == data


def test_known_codes():
    assert tiff.unpackbits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 128, 3, 128, 0, 42, 34])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [128, 0, 42, 34])
    assert tiff.unlzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_pages_of_every_layout():
    for n in (0, 1, 192, 193, 192 * 511, 192 * 512 + 1, 192 * 1500):
        payloads = [tiff.payload_of(chr(97 + k) * n) for k in range(26)]
        for p in payloads[:: 1 if n < 1000 else 5]:
            assert b"".join(x.pixels for x in tiff.pages_of(tiff.encode(p))) == p


def big_endian_gray():
    """A page of 5 x 2 plain gray samples in the other byte order, in two strips."""
    pixels = bytes(range(10))
    tags = [(256, 3, 5), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 1), (277, 3, 1), (278, 3, 1)]
    head = b"MM\0*" + struct.pack(">I", 8 + 10 + 16) + pixels
    lists = struct.pack(">4I", 8, 13, 5, 5)
    body = struct.pack(">H", len(tags) + 2) + b"".join(struct.pack(">HHIHH", t, k, 1, v, 0) for t, k, v in tags)
    body += struct.pack(">HHII", 273, 4, 2, 18) + struct.pack(">HHII", 279, 4, 2, 26) + struct.pack(">I", 0)
    return head + lists + body, pixels


def test_reader_rows(spark, docs):
    gray, pixels = big_endian_gray()
    loop = bytearray(tiff.encode(tiff.payload_of("x")))
    loop[-4:] = loop[4:8]
    rows = [(1, gray), (2, b"no image"), (3, None), (4, b""), (5, bytes(loop)), (6, tiff.encode(tiff.payload_of("y" * 200_000))), (7, gray[:-30])]
    got = tiff.pages(spark.createDataFrame(rows, "doc_id long, content binary")).orderBy("doc_id", "page").collect()
    by = {k: [r for r in got if r["doc_id"] == k] for k in range(1, 8)}
    assert (by[1][0]["width"], by[1][0]["height"], bytes(by[1][0]["pixels"])) == (5, 2, pixels)
    assert "not a TIFF" in by[2][0]["error"] and not by[3] and not by[4] and "loop" in by[5][-1]["error"] and by[7][0]["error"]
    assert len(by[6]) == 3 and b"".join(bytes(r["pixels"]) for r in by[6]).rstrip() == b"y" * 200_000


def test_tiff_round_trip(spark, docs):
    texts = Counter(tiff.payload_of(r["text"] or "") for r in docs.collect())
    got = tiff.round_trip(docs).collect()
    assert Counter(r["payload_sha256"] for r in got) == Counter({hashlib.sha256(p).hexdigest(): n for p, n in texts.items()})
    want = {hashlib.sha256(p).hexdigest(): (len(p), zlib.crc32(p[-16:]), len(m := tiff.encode(p)), hashlib.sha256(m).hexdigest()) for p in texts}
    assert all((r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want[r["payload_sha256"]] for r in got)
    assert 1 << 60 in {r["doc_id"] for r in got} and tiff.round_trip(docs.limit(0)).count() == 0
    assert tiff.pages(tiff.store(docs)).where("error is not null").count() == 0


# --- WARC ----------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://u/1", "<p>a</p>"), (2, None, "<p>a</p>"), (None, "http://u/ü\n", "<p>a</p>"), (3, "x", None), (-5, "y", ""), (2, None, "<p>a</p>"), (1 << 60, "z", "long " * 50_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1, 2) for r in PAGES] + [(100 + k, f"u{k}", f"<html>{k % 7} page</html>" * 20, 1, 2) for k in range(60)], "page_id long, url string, html string, _key int, _first int")
    folder = scratch(spark, "warc")
    manifest = warc.write(pages, folder)
    got = warc.page_rows(warc.read(spark, folder)).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first, want = {}, []
    for p, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        want.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("revisit", first[h]) if h in first else ("response", None))))
        first.setdefault(h, p)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got) and sum(r["records"] for r in manifest.collect()) == len(rows)
    records = warc.read(spark, folder).select("headers").collect()
    ids = {r["headers"]["warc-record-id"]: r["headers"] for r in records}
    assert len(ids) == len(records) and all(ids[r["headers"]["warc-refers-to"]]["warc-type"] == "response" for r in records if r["headers"]["warc-type"] == "revisit")
    payloads = {r["headers"]["warc-page-id"]: bytes(r["payload"]) for r in warc.read(spark, folder).where("headers['warc-type'] = 'response'").collect()}
    assert payloads[str(1 << 60)] == b"long " * 50_000 and payloads["1"] == b"<p>a</p>"
    empty = scratch(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_archive_frames_and_damage():
    shared = warc.dictionary([f"<html><body>some page {k} with words</body></html>".encode() * 8 for k in range(200)])
    w = warc.Writer(shared)
    for k in range(20):
        w.add(warc.written(k, f"u{k}", f"<html><body>some page {k}</body></html>".encode()))
    data = w.archive()
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE and shared
    found = list(warc.records(data))
    assert [r.payload for r in found] == [f"<html><body>some page {k}</body></html>".encode() for k in range(20)]
    assert [warc.page_of(r.headers["warc-record-id"]) for r in found] == list(range(20))
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))
    whole = warc.written(1, "u", b"payload")
    for bad in (whole[:-1], whole.replace(b"WARC/1.1", b"WARC/9"), whole.replace(b"payload\r", b"pAyload\r"), whole.replace(b"WARC-Date", b"X-Date"), whole + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    assert warc.page_of(warc.record_id(-5, 7)) == -5


# --- BPE and ORC ---------------------------------------------------------------------------------------------------

ALPHABET = "abcABC  \n\t\x1c\x1e\x85  é́éΣσςİıßÀÅ漢字かな😀👩‍👩‍👧 12३٣''s'T'll<|endoftext|>,.!?-_ ﬀẞ"


def test_encoding_equals_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "   ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "aaaa" * 3000, "!?" * 500, "ΑΣ ΑΣΑ", "The 'S I'LL don't", "x" * 100_000]
    v = bpe.Vocabulary(vocabulary())
    for e in (bpe.Encoder(bpe.ChunkEncoder(v)), orc_tokens.library_encoder(vocabulary())):
        for t, x in zip(texts, e.encode(texts), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            ids = np.frombuffer(x, "<u4")
            assert ids.tolist() == want, t
            assert v.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    """Each between two letters, which shows its class and what it is normalised to."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b" for c in points[k : k + 1000]) for k in range(0, len(points), 1000)]
    e = bpe.Encoder(bpe.ChunkEncoder(bpe.Vocabulary(vocabulary())))
    for t, x, want in zip(texts, e.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert x == np.array(want.ids, "<u4").tobytes(), hex(ord(t[1]))


def test_long_words(library):
    """Parts and joints give the library's ids, in time that grows with the length."""
    rng, e = random.Random(8), bpe.Encoder(bpe.ChunkEncoder(bpe.Vocabulary(vocabulary())))
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(bpe.LONG, 900))) for alphabet in ("abethnr", "ab", letters, "!?.-=", "éß漢字か") for _ in range(60)]
    words += ["ab" * 5000, "a" * 70_001, "the" * 9000, ".." * 3000 + "x"]
    for w, x in zip(words, e.encode(words), strict=True):
        assert x == np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    for w in ("".join(rng.choice(letters) for _ in range(1_000_000)), "a" * 1_000_000):
        began = time.process_time()
        (x,) = e.encode([w])
        assert time.process_time() - began < 5
        assert x == np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def test_joints_that_reach_far(monkeypatch):
    """Parts of two bytes, so that nearly every joint changes the tokens around it."""
    v, rng = bpe.Vocabulary(vocabulary()), random.Random(2)
    words = ["".join(rng.choice("etaonihs") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    want = v.merge(words)
    monkeypatch.setattr(bpe, "PART", 2)
    monkeypatch.setattr(bpe, "LONG", 1)
    assert v.merge(words) == want


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{k % 90} other{k}" for k in range(400)]
    fresh = lambda: bpe.Encoder(bpe.ChunkEncoder(bpe.Vocabulary(vocabulary())))
    want = list(fresh().encode(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "BLOCK", 200)
    assert list(fresh().encode(texts)) == want
    monkeypatch.setattr(bpe, "LONG", 3)
    assert list(fresh().encode(texts)) == want


def test_merges_that_must_wait():
    """Where a merge of the new symbol ranks lower than the merge itself, only the leftmost pair is merged in a round."""
    v = bpe.Vocabulary(vocabulary())
    v.all_at_once = np.zeros_like(v.all_at_once)
    words = [b"abababab", b"tthhtthh", b"aaaaaaa"]
    assert v.merge(words) == bpe.Vocabulary(vocabulary()).merge(words)


def test_bpe_tables(spark, docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in rows for ids in [library.encode(r["text"] or "", add_special_tokens=False).ids])
    assert Counter(tuple(r)[1:] for r in bpe.digests(docs, vocabulary()).collect()) == want
    encoded = bpe.encode(docs, vocabulary())
    back = bpe.decode(encoded, vocabulary()).collect()
    assert Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in back) == Counter(x for (_, _, x), n in want.items() for _ in range(n))
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0


def test_orc_files(spark, docs, library):
    path = scratch(spark, "orc")
    orc_tokens.write(docs, path, vocabulary())
    got = sorted(orc_tokens.digests(spark, path).collect(), key=lambda r: r["start"])
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(x := np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()), len(x) // 4) for r in docs.collect()))
    start = 0
    for r, (known, doc_id, crc, n) in zip(got, rows, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id if known else None, start, n, crc)
        start += n
    one = orc_tokens.read(spark, path, [7])
    assert one.count() == 1 and "PushedFilters: [" in one._jdf.queryExecution().toString() and "doc_id" in one._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("]")[0]
    empty = scratch(spark, "orc")
    orc_tokens.write(docs.limit(0), empty, vocabulary())
    assert orc_tokens.digests(spark, empty).count() == 0
    many = spark.createDataFrame([(k if k % 3 else None if k % 2 else 60, f"text {k}") for k in range(200)], "doc_id long, text string").repartition(6)
    orc_tokens.write(many, path := scratch(spark, "orc"), vocabulary())
    got = orc_tokens.digests(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in many.collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


# --- URLs ----------------------------------------------------------------------------------------------------------


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    rng = random.Random(8)
    parts = ["http://", "://", "a.", "NET", "example.", "com", "org", "/", "en/", "de/", "fr/", "?", "#", "x", "é", "\n", ":"]
    given = [None, "", "http://net", "http://net/", "http://xnet/", "http://a.EXAMPLE.net/en/x?y#z", "ftp://org/fr/", "http://example.com/de"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    df = spark.createDataFrame([(k, u, 1) for k, u in enumerate(given)], "page_id long, url string, entropy int")
    got = urls.judge(df, urls.fit(df.limit(0).withColumn("label", F.lit(1)))).collect()
    assert len(got) == len(given)
    for r in got:
        host, path, rule, verdict = plain_rule(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_trees_on_held_out_hosts(spark):
    """Hosts of the tested URLs, and all their words, are new; the classes differ in shape only, as in letters, digits, hyphens and parameters."""
    rng = random.Random(2)
    word = lambda n=7: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for h in range(300):
        bad = h % 4 == 0
        host = f"{word()}-{word(4)}{rng.randint(10, 999)}-{word(3)}.example.org" if bad else f"{rng.choice(['', 'www.', 'm.'])}{word()}{'-' + word(3) if rng.random() < 0.1 else ''}.example.org"
        for _ in range(5):
            rows.append((len(rows), f"http://{host}/en/{rng.randint(1, 9999)}" + ("?a=1&b=2&c=3" if rng.random() < (0.5 if bad else 0.1) else ""), int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = urls.fit(df.where("page_id < 1000"))
    got = urls.judge(df.where("page_id >= 1000"), model).join(df, "page_id").select("verdict", "label").collect()
    count = Counter((r["verdict"], r["label"]) for r in got)
    assert count["block", 1] >= 0.9 * (count["block", 1] + count["allow", 1]) and count["block", 1] >= 0.9 * (count["block", 1] + count["block", 0]) and len(got) == 500
    twice = df.where("page_id >= 1400").union(df.where("page_id >= 1400"))
    assert sorted(map(tuple, urls.judge(twice, model).collect())) == sorted(2 * [tuple(r) for r in urls.judge(df.where("page_id >= 1400"), model).collect()])
    assert urls.fit(df.where("label = 1")).trees is None and urls.judge(df.limit(0), model).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------


def plain_partition(items, n):
    """Smallest capacity, and greedy first keys of the later shards; items: (key, size) in order."""
    low, high = max([b for _, b in items] + [1]), max(1, sum(b for _, b in items))

    def greedy(capacity):
        cuts, held = [], 0
        for k, b in items:
            if held + b > capacity:
                cuts.append(k)
                held = 0
            held += b
        return cuts

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(greedy(mid)) < n else (mid + 1, high)
    return high, greedy(high)


def test_partition_of_units():
    rng = random.Random(2)
    for _ in range(400):
        items = dict(("".join(rng.choice("0123") for _ in range(6)), rng.choice([1, 2, 5, 100, 1000 if rng.random() < 0.02 else 3])) for _ in range(rng.choice([1, 2, 9, 40, 300])))
        items = sorted(items.items())

        def units(digits, prefix=""):
            found = {}
            for k, b in items:
                if k.startswith(prefix):
                    u = found.setdefault(k[:digits], [0, 0])
                    u[0] += b
                    u[1] += 1
            return {k: sharding.Unit(k, *v) for k, v in found.items()}

        known = units(1)
        while split := sharding.Partition(list(known.values()), 8).unsure():
            for u in split:
                del known[u.prefix]
                known |= units(len(u.prefix) + 1, u.prefix)
        p = sharding.Partition(list(known.values()), 8)
        capacity, cuts = plain_partition(items, 8)
        assert p._least(False) == capacity and [next(k for k, _ in items if k >= c) for c in p.cuts()] == cuts


@pytest.mark.parametrize("shards", [1, 3, 8, 100])
def test_shards_of_documents(spark, docs, shards):
    rows = sharding.assign(docs, shards).collect()
    assert len(rows) == docs.count()
    groups = {}
    for r in docs.collect():
        t = (r["text"] or "").encode()
        groups[k] = groups.get(k := hashlib.md5(t).hexdigest(), 0) + len(t) + 1
    _, cuts = plain_partition(sorted(groups.items()), shards)
    assert all(r["shard"] == sum(r["key"] >= c for c in cuts) < shards for r in rows)
    for s in range(shards):
        mine = sorted((r["slot"], r["key"]) for r in rows if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert sharding.assign(docs.limit(0), shards).count() == 0


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_by_stages(spark, docs, tmp_path):
    """Every stage keeps what it should, and run() is the stages one after another."""
    import corpus_pipeline as C

    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "and", "to", "in", "sea", "sky", "hill", "stone"]) for _ in range(60)) for _ in range(40)]
    rows = [(k, t + f" unique{k} a{k}@b.example.com", "en", f"s{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [(100 + k, rows[k][1], "en", "s9", 5) for k in range(5)] + [(200, "too short", "en", "s0", 9), (201, None, None, None, None)]
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(C.STAGES)
    kept = stages["quality rules"](spark, df, folder)
    assert {r["doc_id"] for r in kept.collect()} == {*range(40), *range(100, 105)}
    one = stages["near-dedup"](spark, kept, folder)
    assert sorted(r["doc_id"] for r in one.collect()) == list(range(40))
    clean = stages["personal data"](spark, one, folder)
    assert clean.where("text like '%@%'").count() == 0 and clean.count() == 40 and clean.columns == df.columns
    mixed = stages["mixing"](spark, clean, folder)
    assert mixed.columns == df.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = C.run(spark, folder).collect()
    ids = Counter(r["doc_id"] for r in out)
    assert ids == Counter(r["doc_id"] for r in mixed.collect())
    library = Tokenizer.from_file(vocabulary())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in out)


def test_workers_keep_no_words_after_a_task(spark, docs):
    """A Python worker that has encoded lives on, and gives back what it remembered for its task."""
    path = vocabulary()
    for coded in (bpe.digests(docs, path), bpe.encode(docs, path)):
        assert len(coded.collect()) == docs.count()

        def left(batches):
            for b in batches:
                _, e = bpe.encoder(path)
                yield b.set_column(0, "id", pa.array([len(e.memory.known) + e.memory.size + len(e.new.memory.known) + e.new.memory.size] * b.num_rows, pa.int64()))

        assert {r["id"] for r in spark.range(0, 16, 1, 16).mapInArrow(left, "id long").collect()} == {0}
