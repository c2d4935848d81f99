"""Overlapping UTF-8 byte windows of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, OVERLAP_BYTES, MIN_PARENT_BYTES = 4000, 400, 25_000
#: Texts that are cut at once.
ROWS = 512


def version(chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> str:
    return f"transcript-v1:{chunk_bytes}:{overlap_bytes}"


def windows(text: str, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> Iterator[tuple[int, int, int, str]]:
    """(index, start byte, end byte, content); no window splits a character."""
    raw = text.encode("utf-8", "replace")
    for index, (start, end) in enumerate(spans(raw, chunk_bytes, overlap_bytes)):
        yield index, start, end, raw[start:end].decode()


def spans(raw: bytes, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> Iterator[tuple[int, int]]:
    """(start byte, end byte) of the windows of a text in UTF-8."""
    if chunk_bytes <= 0 or not 0 <= overlap_bytes < chunk_bytes:
        raise ValueError("the overlap must be smaller than the chunk")
    inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    start = 0
    while start < len(raw):
        end = min(len(raw), start + chunk_bytes)
        while inside(end):
            end -= 1
        if end <= start:
            raise ValueError("a character is larger than the chunk")
        yield start, end
        if end == len(raw):
            return
        after = end - overlap_bytes
        while inside(after):
            after += 1
        start = after if after > start else end


def split(rows: DataFrame, key: str, text: str = "content", chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES, min_bytes: int = 0, contents: bool = True) -> DataFrame:
    """(parent_id, chunk_index, start_byte, end_byte, content) of texts longer than min_bytes; content only with contents."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                raw = part.column(1).cast(pa.binary()).to_pylist()
                found = [(r, n, *span) for r, t in enumerate(raw) for n, span in enumerate(spans(t, chunk_bytes, overlap_bytes))]
                of, index, start, end = ([x[c] for x in found] for c in range(4))
                columns = [part.column(0).take(pa.array(of, pa.int32())), *(pa.array(x, pa.int32()) for x in (index, start, end))]
                if contents:
                    columns.append(pa.array((raw[r][a:z].decode() for r, _, a, z in found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["parent_id", "chunk_index", "start_byte", "end_byte", "content"]
    long = rows.where(F.octet_length(text) > min_bytes).select(F.col(key).alias("parent_id"), text)
    return long.mapInArrow(run, f"parent_id {kind}, chunk_index int, start_byte int, end_byte int" + (", content string" if contents else ""))


def state(chunks: DataFrame) -> DataFrame:
    """Per parent: number of chunks, distinct versions and hashes, and their least values."""
    return chunks.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("version").alias("versions"), F.countDistinct("parent_hash").alias("hashes"),
        F.min("version").alias("version"), F.min("parent_hash").alias("parent_hash"),
    )


def stale(parents: DataFrame, chunks: DataFrame, wanted: str) -> DataFrame:
    """parents(id, content_hash) whose chunks are missing, mixed, or made from other content or settings."""
    same = (F.col("versions") == 1) & (F.col("hashes") == 1) & (F.col("version") == wanted) & (F.col("parent_hash") == F.col("content_hash"))
    known = state(chunks).withColumnRenamed("parent_id", "id")
    return parents.join(known, "id", "left").where(~F.coalesce(same, F.lit(False))).select(*parents.columns)


def rebuilt(parents: DataFrame, chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES, min_bytes: int = MIN_PARENT_BYTES) -> DataFrame:
    """The chunk table (parent_id, chunk_index, start_byte, end_byte, content, version, parent_hash) after a run.

    parents(id, content, content_hash): chunks of those over min_bytes that are stale are made anew, all others stay, and so do those of
    parents that are not among them.
    """
    wanted = version(chunk_bytes, overlap_bytes)
    old = stale(parents.where(F.octet_length("content") > min_bytes), chunks, wanted)
    columns = ["parent_id", "chunk_index", "start_byte", "end_byte", "content", "version", "parent_hash"]
    new = split(old, "id", "content", chunk_bytes, overlap_bytes, min_bytes).join(old.select(F.col("id").alias("parent_id"), F.col("content_hash").alias("parent_hash")), "parent_id")
    stays = chunks.join(old.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return stays.select(columns).unionByName(new.withColumn("version", F.lit(wanted)).select(columns))


def estimate(parents: DataFrame, chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES, min_bytes: int = MIN_PARENT_BYTES) -> DataFrame:
    """One row on a run to come: parents, those unchanged, those to rebuild with their chunks and bytes, and the largest parent."""
    long = parents.where(F.octet_length("content") > min_bytes)
    old = stale(long, chunks, version(chunk_bytes, overlap_bytes))
    made = split(old, "id", "content", chunk_bytes, overlap_bytes, min_bytes).agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("chunk_bytes"))
    whole = long.agg(F.count(F.lit(1)).alias("parents"), F.max_by("id", F.struct(F.octet_length("content"), F.col("id"))).alias("largest"), F.max(F.octet_length("content")).alias("largest_bytes"))
    again = old.agg(F.count(F.lit(1)).alias("rebuild"))
    out = whole.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(made))  # one row each
    return out.select("parents", (F.col("parents") - F.col("rebuild")).alias("unchanged"), "rebuild", "chunks", "chunk_bytes", "largest", "largest_bytes")
