"""Files that lie or are broken give rows with errors, never a dead task or much memory."""

import random
import struct
import tracemalloc
import zlib

import pytest

from tesserae.llm import tiff


def file_of(tags: dict, body: bytes = b"") -> bytes:
    """A little-endian file of one directory of 32-bit values, and body behind it."""
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + body


def page(width, height, body, compression=8, **more):
    tags = {256: width, 257: height, 258: 8, 259: compression, 277: 1, 278: height, 279: len(body)} | {int(k[1:]): v for k, v in more.items()}
    tags[273] = 8 + 2 + 12 * (len(tags) + 1) + 4
    return file_of(tags, body)


def test_a_sound_page_is_read():
    pixels = bytes(range(12))
    assert next(tiff.pages_of(page(4, 3, zlib.compress(pixels)))).pixels == pixels


@pytest.mark.parametrize("data", [
    page(4_000_000, 4_000_000, b"x" * 10), page(65_000, 65_000, zlib.compress(bytes(1 << 20))), page(4, 0, b""), page(4, 3, zlib.compress(bytes(12)), t266=2), page(4, 3, zlib.compress(bytes(12)), t278=0),
    page(4, 3, zlib.compress(bytes(11))), page(4, 3, b"", compression=7), page(4, 3, bytes(5), compression=1), page(4, 3, zlib.compress(bytes(12)), t278=1),
])
def test_lies_are_errors_without_allocation(data):
    tracemalloc.start()
    with pytest.raises((ValueError, zlib.error)):
        list(tiff.pages_of(data))
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()


def test_bombs_are_unpacked_to_their_page_only():
    bomb = zlib.compress(bytes(200 << 20))
    tracemalloc.start()
    assert next(tiff.pages_of(page(4, 3, bomb))).pixels == bytes(12)
    assert len(tiff.unlzw(tiff.lzw(bytes(1 << 20)), 1000)) < 1 << 18
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_mutated_files_give_rows(spark):
    rng = random.Random(8)
    whole = [tiff.encode(tiff.payload_of(t)) for t in ("a", "some words " * 40, "x" * 3000, "tiles " * 90, "other " * 200, "more " * 77)]
    rows = []
    for k in range(1000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 8)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append((k, bytes(data[: rng.randint(0, len(data))] if k % 5 == 0 else data)))
    found = tiff.pages(spark.createDataFrame(rows, "doc_id long, content binary").repartition(4)).collect()
    assert len({r.doc_id for r in found}) >= 990 and any(r.error for r in found) and any(r.error is None for r in found)  # empty files give none
