"""WARC archives in Zstandard: a writer with revisit records, and a reader that validates what it reads.

An archive begins with a skippable frame that holds the dictionary (plain or itself compressed); each record is one
frame of its own, compressed with that dictionary. The reader loads the dictionary, decodes frame by frame, and
checks the version line, the mandatory headers, the record's and the payload's lengths and the digests.

Archives are written by tasks into a folder of any file system that pyarrow can reach (local, HDFS, S3, GCS), under names
of their own for each attempt; a manifest table lists those that count. Their size is bounded by ARCHIVE_BYTES and one
record more, and reading is spread over archives.

Defined results: a null payload is empty, a null url is left out. Every row is a record of its own id. Of the rows of one
payload that of the smallest page_id (of several, that of the smallest url) is the response, and all others are revisits of
it, repeated rows of its own page_id too. A null page_id counts as larger than any other, and a revisit of a response
without one names no page. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import hashed_sample, spread_join, text_of

#: Fixed values of the formats.
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Uncompressed bytes after which a task starts its next archive; the bounded sample that the dictionary is fitted on, and its size.
ARCHIVE_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 32 << 20, 400, 4 << 20, 48 << 10
DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, high: int) -> str:
    """An id with the page in its lower half; high: 64 bits that tell records of a page apart."""
    return f"<{uuid.UUID(int=high % (1 << 64) << 64 | (page_id or 0) % (1 << 64)).urn}>"


def page_of(identifier: str) -> int:
    n = uuid.UUID(identifier.strip("<>")).int % (1 << 64)
    return n - (1 << 64) if n >> 63 else n


def written(page_id: int | None, url: str | None, payload: bytes, high: int | None = None) -> bytes:
    """A response with its payload. Its id has the beginning of the payload's SHA-1 in it, or high."""
    sha1 = hashlib.sha1(payload).digest()
    own = record_id(page_id, int.from_bytes(sha1[:8], "big") if high is None else high)
    return _record("response", own, page_id, url, sha1, len(payload), [], HTTP + payload)


def revisit(page_id: int | None, url: str | None, sha1: bytes, size: int, first: int | None, high: int) -> bytes:
    """A record without the payload, which the response of the page first holds; high: as in record_id."""
    more = [("WARC-Refers-To", record_id(first, int.from_bytes(sha1[:8], "big"))), *([("WARC-Refers-To-Page-ID", str(first))] if first is not None else []), ("WARC-Profile", PROFILE)]
    return _record("revisit", record_id(page_id, high), page_id, url, sha1, size, more, HTTP)


def _record(kind: str, own: str, page_id: int | None, url: str | None, sha1: bytes, size: int, more: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"), ("WARC-Payload-Length", str(size)), *more]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary for payloads; empty where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads, threads=0).as_bytes() if len(payloads) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """Collects records into the bytes of one archive."""

    def __init__(self, dict_bytes: bytes) -> None:
        import zstandard

        packed = zstandard.ZstdCompressor(level=9).compress(dict_bytes) if dict_bytes else b""
        self.parts = [struct.pack("<II", SKIPPABLE, len(packed)) + packed]
        self.frames = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dict_bytes) if dict_bytes else None)
        self.size = self.records = 0

    def add(self, record: bytes) -> None:
        self.parts.append(self.frames.compress(record))
        self.size += len(record)
        self.records += 1

    def archive(self) -> bytes:
        return b"".join(self.parts)


def parsed(data: bytes) -> Record:
    """One record's bytes, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first not in (b"WARC/1.0", VERSION):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without a colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in MANDATORY:
        if name not in headers:
            raise ValueError(f"no {name}")
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n" or n < 0:
        raise ValueError("content length does not fit")
    _, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers.get("warc-payload-length", str(len(payload))) != str(len(payload)):
            raise ValueError("payload length does not fit")
        if headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise ValueError("payload digest does not fit")
    return Record(headers, payload)


def records(archive: bytes) -> Iterator[Record]:
    """The records of an archive, one frame each."""
    import zstandard

    at, data = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        raw, at = archive[8 : 8 + size], 8 + size
        if len(raw) < size:
            raise ValueError("the dictionary's frame is cut short")
        if raw[:4] == struct.pack("<I", ZSTD):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        data = zstandard.ZstdCompressionDict(raw) if raw else None
    reader, view = zstandard.ZstdDecompressor(dict_data=data), memoryview(archive)
    while at < len(archive):
        frame = reader.decompressobj()
        parts, step = [], 1 << 16
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(view[at : at + step]))
            at += min(step, len(archive) - at)
        at -= len(frame.unused_data)
        yield parsed(b"".join(parts))


def _file_system(folder: str):
    """pyarrow's file system for a folder's address, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _records_of(rows: DataFrame, folder: str, least: int) -> DataFrame:
    """(page_id, url, html, sha1, size, first) of rows(page_id, url, html): html is null for revisits, first is theirs.

    Payloads are aggregated where they lie, so of equal ones each task sends one; of all other rows only ids, urls and digests
    move, and those of a payload that many rows share stay where they are (spread_join).
    """
    spark = rows.sparkSession
    payload = F.encode("html", "UTF-8")
    own = F.octet_length(payload) >= least
    alone = rows.where(~own).select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"), F.lit(None).cast("long").alias("first"))
    keyed = rows.where(own).withColumn("sha1", F.sha1(payload))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    best = keyed.groupBy("sha1").agg(F.min_by(F.struct("page_id", "url", "html"), order).alias("b"))
    responses = best.select("b.page_id", "b.url", "b.html", "sha1", F.octet_length(F.encode("b.html", "UTF-8")).cast("long").alias("size"), F.lit(None).cast("long").alias("first"))
    keyed.groupBy("sha1", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length(payload)).cast("long").alias("size")).write.parquet(path := f"{folder}/ids")
    ids = spark.read.parquet(path)
    first = ids.groupBy("sha1").agg(F.min_by(F.struct("page_id", "url"), order).alias("b"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).where("all > 1")
    found = spread_join(ids, first.select("sha1", "b", "rows"), "sha1", ids.count(), "rows")
    # of the repeated rows of the response itself, one is the response
    again = F.col("n") - F.when(F.col("page_id").eqNullSafe(F.col("b.page_id")) & F.col("url").eqNullSafe(F.col("b.url")), 1).otherwise(0)
    copies = found.withColumn("again", again).where("again > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("again").cast("int"))))
    revisits = copies.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", F.col("b.page_id").cast("long").alias("first"))
    return alone.unionByName(responses).unionByName(revisits)


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of pages(page_id, url, html) in folder; the manifest (archive, records), itself stored there."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(pages, "html").alias("html"))
    sample = hashed_sample(rows.where("page_id is not null"), "page_id", SAMPLE_ROWS).select(F.substring("html", 1, SAMPLE_BYTES // SAMPLE_ROWS).alias("h"))
    shared = dictionary([h.encode("utf-8", "replace") for h in sorted({r["h"] for r in sample.collect()})])  # about SAMPLE_ROWS beginnings
    ready = _records_of(rows, folder, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        task, done = TaskContext.get(), []

        def store(w: Writer) -> None:
            # a repeated attempt has a name of its own, so no half-written file is ever listed
            name = f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(w.archive())
            done.append((name, w.records))

        w, number = Writer(shared), (1 << 63) | task.partitionId() << 32
        for b in batches:
            for page_id, url, html, sha1, size, first in zip(*(c.to_pylist() for c in b.columns)):
                number += 1
                if html is None:
                    w.add(revisit(page_id, url, bytes.fromhex(sha1), size, first, number))
                else:
                    w.add(written(page_id, url, html.encode("utf-8", "replace"), number if size < least else None))
                if w.size >= ARCHIVE_BYTES:
                    store(w)
                    w = Writer(shared)
        if w.records:
            store(w)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64()))], ["archive", "records"])

    manifest = f"{folder}/manifest.parquet"
    ready.mapInArrow(run, "archive string, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record of the archives in the manifest: headers map, payload binary, archive, place (record number).

    A record that is not valid, or a manifest that counts other records than its archive holds, fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _file_system(folder)
        for b in batches:
            for name, count in zip(b["archive"], b["records"]):
                with system.open_input_stream(f"{path}/{name}") as f:
                    found = list(records(f.read()))
                if len(found) != count:
                    raise ValueError(f"{name} holds {len(found)} records, not {count}")
                for k in range(0, count, 256):
                    part = found[k : k + 256]
                    yield pd.DataFrame({"archive": name, "place": range(k, k + len(part)), "headers": [r.headers for r in part], "payload": [r.payload for r in part]})

    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    spread = manifest.repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    return spread.mapInPandas(run, "archive string, place int, headers map<string,string>, payload binary")


def page_rows(read_back: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read."""
    h = F.col("headers")
    return read_back.select(
        h["warc-page-id"].cast("long").alias("page_id"), h["warc-payload-length"].cast("long").alias("payload_bytes"),
        F.regexp_replace(h["warc-payload-digest"], "^sha1:", "").alias("payload_digest"), h["warc-type"].alias("record_type"), h["warc-refers-to-page-id"].cast("long").alias("refers_to"),
    )
