"""The registered queries themselves: columns and rows of their contracts on the smallest tables."""

import zlib

import pytest

from tesserae.llm import queries
from tesserae.llm.common import table

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_tiff": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_mixing": "doc_id size source_size target taken",
    "op6_urls": "page_id host path rule verdict",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_orc": "doc_id start n_tokens ids_crc32",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows, key = found.collect(), COLUMNS[name].split()[0]
    texts = {r[key]: r for r in table(spark, DIR, "pages" if key == "page_id" else "documents").collect()}
    assert sorted(r[key] for r in rows) == sorted(texts)
    raw = lambda r: (texts[r[key]]["text"] or "").encode()
    if name == "op3_tiff":
        for r in rows:
            payload = raw(r).ljust(max(1, -(-len(raw(r)) // 192)) * 192, b" ")
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw(r)), len(payload), zlib.crc32(payload[-16:]))
    if name == "op5_mixing":
        words = {k: len((t["text"] or "").split()) for k, t in texts.items()}
        sizes: dict = {}
        for k, t in texts.items():
            sizes[t["source"]] = sizes.get(t["source"], 0) + words[k]
        for r in rows:
            assert r["source_size"] == sizes[texts[r.doc_id]["source"]] and 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        assert sum({texts[r.doc_id]["source"]: r.target for r in rows}.values()) == pytest.approx(sum(sizes.values()))
    if name == "op6_urls":
        assert {r.verdict for r in rows} <= {"allow", "block"} and all(r.verdict == "block" for r in rows if r.rule in ("net/", "example.com/de/"))
    if name == "op7_sharding":
        shards: dict = {}
        for r in rows:
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw(r)) + 1, zlib.crc32(raw(r)), "bytes", None)
            shards.setdefault(r.shard, []).append(r.slot)
        assert set(shards) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
