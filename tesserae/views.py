"""The memory store as a view over the tables documents and embeddings, in Spark and in SQL.

The corpus holds no scopes, tags or secrets, so they are derived from doc_id by the same rules on both sides.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import content_hash, resolved_key

NOW = datetime(2024, 3, 1)
QUERY = "remember the deadline thereforce"
QUERY_VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One row a document, with the columns of a stored memory; the embedding only with vectors."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    by = lambda n: i % n == 0
    content = F.when(by(17), F.concat(F.lit("Favorite "), "lang", F.lit(" color: "), (i % 5).cast("string")))
    content = content.when(by(19), F.concat(text, F.lit(" key sk-"), F.substring(F.sha2(i.cast("string"), 256), 1, 24), F.lit(" Bearer "), F.substring(F.sha2(i.cast("string"), 256), 30, 22)))
    content = content.when(by(23), F.concat(F.lit("Assistant: "), text)).when(by(29), F.concat(text, F.lit("\nWe must always remember the deadline: day 7."))).otherwise(text)
    strings = lambda *xs: F.array(*map(F.lit, xs))
    tags = F.when(by(17), strings("canonical", "user-preference")).when(by(7), strings("captured")).when(by(11), strings("import", "chatgpt-export", "transcript"))
    tags = tags.when(by(13), strings("turn-log")).when(by(10), strings("design")).otherwise(F.array().cast("array<string>"))
    created = F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (i % 100_000).cast("int"))
    rows = (d.join(e, "doc_id", "left") if vectors else d).select(
        i.cast("string").alias("id"), i.alias("seq"),
        F.when(i % 3 == 0, "global").when(i % 3 == 1, "project").otherwise("session").alias("scope_type"),
        F.when(i % 3 == 1, F.sha2(F.concat(F.lit("p"), (i % 4).cast("string")), 256)).when(i % 3 == 2, F.concat(F.lit("s"), (i % 5).cast("string"))).alias("scope_id"),
        content.alias("content"), tags.alias("tags"), ((i % 11) / 10.0).alias("importance"), by(7).alias("captured"),
        F.when(by(5), "cli-import").otherwise("editor").alias("source_agent"), *(["embedding"] if vectors else []), created.alias("created_at"), created.alias("updated_at"),
        F.when(by(26), created + F.make_dt_interval(F.lit(10))).when(by(13), created + F.make_dt_interval(F.lit(3650))).alias("expires_at"),
        F.when(by(31), created).alias("deleted_at"),
    )
    return rows.withColumn("canonical_key", resolved_key(F.col("content"), F.col("tags"))).withColumn("content_hash", content_hash(F.col("content")))


#: The same view for the oracle.
MEMORIES_SQL = r"""memories AS (
  SELECT *, CASE WHEN seq % 17 = 0 THEN 'favorite_' || lang || '_color' END AS canonical_key, sha256(content) AS content_hash FROM (
    SELECT doc_id::VARCHAR AS id, doc_id AS seq, lang,
      CASE doc_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'project' ELSE 'session' END AS scope_type,
      CASE doc_id % 3 WHEN 1 THEN sha256('p' || (doc_id % 4)) WHEN 2 THEN 's' || (doc_id % 5) END AS scope_id,
      CASE WHEN doc_id % 17 = 0 THEN 'Favorite ' || lang || ' color: ' || (doc_id % 5)
           WHEN doc_id % 19 = 0 THEN coalesce(text, '') || ' key sk-' || substr(sha256(doc_id::VARCHAR), 1, 24) || ' Bearer ' || substr(sha256(doc_id::VARCHAR), 30, 22)
           WHEN doc_id % 23 = 0 THEN 'Assistant: ' || coalesce(text, '')
           WHEN doc_id % 29 = 0 THEN coalesce(text, '') || chr(10) || 'We must always remember the deadline: day 7.'
           ELSE coalesce(text, '') END AS content,
      CASE WHEN doc_id % 17 = 0 THEN ['canonical', 'user-preference'] WHEN doc_id % 7 = 0 THEN ['captured']
           WHEN doc_id % 11 = 0 THEN ['import', 'chatgpt-export', 'transcript'] WHEN doc_id % 13 = 0 THEN ['turn-log']
           WHEN doc_id % 10 = 0 THEN ['design'] ELSE []::VARCHAR[] END AS tags,
      (doc_id % 11) / 10.0 AS importance, doc_id % 7 = 0 AS captured, CASE WHEN doc_id % 5 = 0 THEN 'cli-import' ELSE 'editor' END AS source_agent,
      embedding::DOUBLE[] AS embedding,
      TIMESTAMP '2024-01-01' + to_minutes((doc_id % 100000)::INT) AS created_at, TIMESTAMP '2024-01-01' + to_minutes((doc_id % 100000)::INT) AS updated_at,
      CASE WHEN doc_id % 26 = 0 THEN TIMESTAMP '2024-01-11' + to_minutes((doc_id % 100000)::INT)
           WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01' + to_days(3650) + to_minutes((doc_id % 100000)::INT) END AS expires_at,
      CASE WHEN doc_id % 31 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id % 100000)::INT) END AS deleted_at
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id))"""
ACTIVE_SQL = "deleted_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01')"
