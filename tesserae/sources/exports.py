"""Chat exports: zip archives with shards of conversations as JSON."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = re.compile(r"(^|/)conversations-\d+\.json$")
MAX_SHARD_BYTES = 256 << 20
NODE = "conv string, id string, parent string, role string, time double, text string"


def _shards(data: bytes) -> Iterator[tuple[str, list | None, str | None]]:
    """(name, conversations, error) of each shard, in order of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted((i for i in z.infolist() if SHARD.search(i.filename)), key=lambda i: i.filename):
            try:
                if info.file_size > MAX_SHARD_BYTES:
                    raise ValueError("shard is too large")
                found = json.loads(z.read(info))
                if not isinstance(found, list):
                    raise ValueError("shard is no list")
                yield info.filename, found, None
            except (ValueError, zipfile.BadZipFile) as e:
                yield info.filename, None, str(e)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a conversation: file, shard, place, body (JSON), error; a bad shard or archive is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                try:
                    for name, found, error in _shards(data):
                        rows += [(file, name, k, json.dumps(c), None) for k, c in enumerate(found)] if found is not None else [(file, name, None, None, error)]
                except zipfile.BadZipFile as e:
                    rows.append((file, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["file", "shard", "place", "body", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, shard string, place double, body string, error string").withColumn("place", F.col("place").cast("int"))


def conversations(read_rows: DataFrame) -> DataFrame:
    """(conv, title, created, updated, current, key) of rows without error; key: the idempotency key of this state."""
    g = lambda path: F.get_json_object("body", path)
    conv = F.trim(F.coalesce(F.nullif(F.trim(g("$.conversation_id")), F.lit("")), g("$.id")))
    created, updated = g("$.create_time").cast("double"), g("$.update_time").cast("double")
    token = F.coalesce(g("$.update_time"), g("$.create_time"), F.lit("unknown"))
    rows = read_rows.where("error is null")
    return rows.select(conv.alias("conv"), g("$.title").alias("title"), created.alias("created"), updated.alias("updated"), g("$.current_node").alias("current"), F.concat(F.lit("chatgpt-export:v1:conv:"), conv, F.lit(":update:"), token).alias("key"), "body")


def covered(rows: DataFrame, now: Column, months: int = 6) -> DataFrame:
    """Conversations touched in the last months; those of unknown time stay."""
    at = F.timestamp_seconds(F.coalesce("updated", "created"))
    return rows.where(at.isNull() | (at >= F.add_months(now, -months).cast("timestamp")))


def nodes(rows: DataFrame) -> DataFrame:
    """(conv, id, parent, role, time, text) of the message trees in body; texts as message_text gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, body in zip(b["conv"], b["body"]):
                for k, n in (json.loads(body).get("mapping") or {}).items():
                    m = (n or {}).get("message") or {}
                    out.append((conv, k, n.get("parent"), (m.get("author") or {}).get("role"), m.get("create_time"), message_text(m.get("content") or {})))
            yield pd.DataFrame(out, columns=["conv", "id", "parent", "role", "time", "text"]).astype({"time": "float64"})

    return rows.select("conv", "body").mapInPandas(run, NODE)


def message_text(content: dict) -> str:
    """Text parts, then the text, trimmed, without empty ones and repeats in a row, joined by line feeds."""
    parts = [p for p in content.get("parts") or [] if isinstance(p, str)] + [content.get("text")] * isinstance(content.get("text"), str)
    clean = [p.replace("\r\n", "\n").strip() for p in parts]
    clean = [p for p in clean if p]
    return "\n".join(p for k, p in enumerate(clean) if not k or clean[k - 1] != p)
