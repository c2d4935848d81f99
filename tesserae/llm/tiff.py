"""TIFF media columns: a reader that emits one row a page, and the writer behind its round trips.

The reader walks the chain of image directories in either byte order, decodes strips and tiles stored plain or as
PackBits, LZW or deflate, undoes horizontal differencing, and gives each page's samples. The writer stores bytes as 8-bit
RGB rows of WIDTH pixels, a page for every PAGE_ROWS rows; the checksum of the payload picks the codec, so equal
payloads give equal files.

Defined results: a null or empty file gives no page; a file that can't be read gives one row with its error and no
samples, and other rows are not affected. For the round trip a null text is empty: a payload of 192 spaces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.llm.common import map_texts

WIDTH, SAMPLES, PAGE_ROWS, STRIP_ROWS, TILE = 64, 3, 512, 64, (64, 32)
ROW = WIDTH * SAMPLES
#: Fixed values of the format: tags and compression schemes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FILL_ORDER = 266
TYPE_SIZE = {1: 1, 3: 2, 4: 4}
TYPE_LETTER = {1: "B", 3: "H", 4: "I"}
CLEAR, STOP, FIRST = 256, 257, 258
#: (compression, predictor, tiled) that a payload's checksum picks from.
LAYOUTS = ((DEFLATE, 2, False), (LZW, 1, False), (PACKBITS, 1, False), (DEFLATE, 1, True), (LZW, 2, True), (DEFLATE, 1, False))
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Bytes that a byte of a scheme can stand for at most, and samples of a page or tile; files that claim more give an error's row.
MOST_RATIO = {PLAIN: 1, PACKBITS: 64, DEFLATE: 1033, OLD_DEFLATE: 1033, LZW: 4096}
MOST_PIXELS = 1 << 28


class Page(NamedTuple):
    """One decoded page; samples are rows of pixels of 8-bit samples."""

    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


# --- codecs --------------------------------------------------------------------------------------------------------

_REPEAT = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = row[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _REPEAT.finditer(row):
        literal(m.start())
        out.append(257 - (m.end() - m.start()))
        out += m[1]
        at = m.end()
    literal(len(row))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
        else:
            if head > 128:
                out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2 if head > 128 else 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the reader, one entry behind, widens at 511, 1023 and 2047."""
    out, width, held, bits = bytearray(), 9, CLEAR, 9  # held: bits not yet written
    single = {bytes([b]): b for b in range(256)}
    table, free, known = dict(single), FIRST, b""
    for k in range(len(data)):
        longer = known + data[k : k + 1]
        if longer in table:
            known = longer
            continue
        held = held << width | table[known]
        bits += width
        table[longer] = free
        free += 1
        if free in (512, 1024, 2048):
            width += 1
        elif free == 4094:
            held, bits = held << width | CLEAR, bits + width
            table, free, width = dict(single), FIRST, 9
        if bits >= 512:
            keep = bits & 7
            out += (held >> keep).to_bytes(bits >> 3, "big")
            held &= (1 << keep) - 1
            bits = keep
        known = data[k : k + 1]
    if known:
        held, bits, free = held << width | table[known], bits + width, free + 1
        if free in (512, 1024, 2048):
            width += 1
    held, bits = held << width | STOP, bits + width
    pad = -bits % 8
    return bytes(out + (held << pad).to_bytes((bits + pad) >> 3, "big"))


def unlzw(data: bytes, limit: int = 1 << 62) -> bytes:
    """The bytes of data, or somewhat more than limit of them."""
    out: list[bytes] = []
    size = seen = 0
    table: list[bytes] = [bytes([b]) for b in range(256)] + [b"", b""]
    base, width, held, bits, last = table[:], 9, 0, 0, b""
    for k in range(0, len(data), 32):
        part = data[k : k + 32]
        held = held << 8 * len(part) | int.from_bytes(part, "big")
        bits += 8 * len(part)
        size, seen = size + sum(map(len, out[seen:])), len(out)
        if size >= limit:
            break
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == STOP:
                return b"".join(out)
            if code == CLEAR:
                table, width, last = base[:], 9, b""
                continue
            if not last:
                last = table[code]
                out.append(last)
                continue
            n = len(table)
            if code < n:
                entry = table[code]
            elif code == n:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            if n < 4096:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            if n == 510 or n == 1022 or n == 2046:
                width += 1
    return b"".join(out)


def _difference(block: np.ndarray) -> np.ndarray:
    """Horizontal differencing of rows x pixels x samples."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


# --- writer --------------------------------------------------------------------------------------------------------


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    raw = (_difference(block) if predictor == 2 else block).tobytes()
    if compression == DEFLATE:
        return zlib.compress(raw, 4)
    if compression == LZW:
        return lzw(raw)
    size = block.shape[1] * block.shape[2]
    return b"".join(packbits(raw[k : k + size]) for k in range(0, len(raw), size))


def encode(payload: bytes) -> bytes:
    """A TIFF file that holds payload, a positive multiple of ROW bytes, as RGB samples."""
    compression, predictor, tiled = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), PAGE_ROWS):
        page = image[top : top + PAGE_ROWS]
        step = TILE[1] if tiled else STRIP_ROWS
        blocks = [page[k : k + step] for k in range(0, len(page), step)]
        if tiled:
            blocks = [np.pad(b, ((0, step - len(b)), (0, 0), (0, 0))) for b in blocks]
        places, counts = [], []
        for b in blocks:
            data = _packed(b, compression, predictor)
            places.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = [(IMAGE_WIDTH, 4, [WIDTH]), (IMAGE_LENGTH, 4, [len(page)]), (BITS, 3, [8] * SAMPLES), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2]), (SAMPLES_PER_PIXEL, 3, [SAMPLES]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tiled:
            tags += [(TILE_WIDTH, 3, [TILE[0]]), (TILE_LENGTH, 3, [TILE[1]]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, counts)]
        else:
            tags += [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 3, [STRIP_ROWS]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"<{len(values)}{TYPE_LETTER[kind]}", *values)
            if len(packed) > 4:
                where, packed = len(out), packed + b"\0" * (len(packed) & 1)
                out += packed
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- reader --------------------------------------------------------------------------------------------------------


def _directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(f"{order}I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,), tags = struct.unpack_from(f"{order}H", data, at), {}
        for k in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, k)
            if kind in TYPE_SIZE:
                where = k + 8 if count * TYPE_SIZE[kind] <= 4 else struct.unpack_from(f"{order}I", data, k + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_LETTER[kind]}", data, where)
        yield tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    """The first size bytes of a strip or tile, without unpacking much more."""
    if compression == PLAIN:
        return data[:size]
    if compression == LZW:
        return unlzw(data, size)[:size]
    if compression == PACKBITS:
        return unpackbits(data)[:size]
    whole = zlib.decompressobj()
    found = whole.decompress(data, size + 1)
    if len(found) < size or len(found) == size and not whole.eof:
        raise ValueError("a strip ends early")
    return found[:size]


def _checked(tags: dict, width: int, height: int, samples: int, across: int, down: int, compression: int, places: tuple, counts: tuple) -> None:
    """Raises ValueError where a page is larger than its strips can hold or than MOST_PIXELS, before anything is allocated for it."""
    if compression not in MOST_RATIO:
        raise ValueError(f"compression {compression} is not supported")
    if tags.get(FILL_ORDER, (1,))[0] != 1:
        raise ValueError("only the highest bit first is supported")
    if min(width, height, samples, across, down) < 1:
        raise ValueError("a page, strip or tile without size")
    blocks = -(-height // down) * -(-width // across)
    if blocks != len(places) or blocks != len(counts):
        raise ValueError(f"{len(places)} places and {len(counts)} sizes for {blocks} strips or tiles")
    size = width * height * samples
    if size > MOST_PIXELS or across * down * samples > MOST_PIXELS or size > sum(counts) * MOST_RATIO[compression]:
        raise ValueError(f"{width} x {height} pixels are more than {sum(counts)} bytes hold or a page may have")


def pages_of(data: bytes) -> Iterator[Page]:
    """Every page of a file, in the order of its directories."""
    for tags in _directories(data):
        one = lambda tag, default=0: tags.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, samples = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES_PER_PIXEL, 1)
        compression, predictor, tiled = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), TILE_OFFSETS in tags
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
            raise ValueError("only chunky 8-bit samples are supported")
        across, down = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
        places, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
        _checked(tags, width, height, samples, across, down, compression, places, counts)
        image = np.zeros((height, width, samples), np.uint8)
        spots = ((y, x) for y in range(0, height, down) for x in range(0, width, across))
        for (y, x), place, count in zip(spots, places, counts, strict=True):
            rows = down if tiled else min(down, height - y)
            block = np.frombuffer(_unpacked(data[place : place + count], compression, rows * across * samples), np.uint8).reshape(rows, across, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + across] = block[: height - y, : width - x]
        yield Page(width, height, samples, compression, predictor, tiled, image.tobytes())


def pages(files: DataFrame, column: str = "content", key: str = "doc_id") -> DataFrame:
    """One row a page of each file: key, page, width, height, samples, compression, predictor, tiled, pixels, error."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]
        for b in batches:
            for k, data in zip(b.iloc[:, 0], b.iloc[:, 1]):
                rows: list[tuple] = []
                try:
                    if data:
                        for n, p in enumerate(pages_of(bytes(data))):
                            rows.append((k, n, *p[:3], NAMES[p.compression], p.predictor, p.tiled, p.pixels, None))
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    rows.append((k, len(rows), *[None] * 7, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("page", "width", "height", "samples", "predictor")}, errors="ignore")

    schema = f"{key} {kind}, page int, width int, height int, samples int, compression string, predictor int, tiled boolean, pixels binary, error string"
    return files.select(key, column).mapInPandas(run, schema)


def payload_of(text: str) -> bytes:
    """UTF-8 with spaces up to a positive multiple of ROW bytes."""
    raw = text.encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, content): each text as a TIFF file."""
    return map_texts(docs, text, {"content": "binary"}, lambda: lambda texts: [[encode(payload_of(t)) for t in texts]])


def _facts(text: str) -> tuple:
    media = encode(payload_of(text))
    found = list(pages_of(media))
    back = b"".join(p.pixels for p in found)
    means = np.frombuffer(back, np.uint8).reshape(-1, SAMPLES).mean(0)
    p = found[0]
    feature = f"pages={len(found)};rows={sum(x.height for x in found)};codec={NAMES[p.compression]};predictor={p.predictor};{'tiles' if p.tiled else 'strips'};mean={'/'.join(f'{m:.3f}' for m in means)}"
    return len(text.encode("utf-8", "replace")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def round_trip(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text as a TIFF file and reads its pages back: sizes, checksums and a feature of every document.

    feature: pages, rows, codec, predictor, layout and the mean of each sample plane over all pages.
    """
    fields = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return map_texts(docs, text, fields, lambda: lambda texts: list(zip(*map(_facts, texts))))
