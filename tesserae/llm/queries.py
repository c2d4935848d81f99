"""Registered queries of the training-data operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, byte_bpe, lexrank, mixing, negatives, orc_tokens, pii, quality, sharding, simhash, tiff, urls, warc
from tesserae.llm.common import scratch, table, trusted_ids, vocabulary


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, trusted_ids(spark, sf_dir))
    return quality.judge(docs, model).select("doc_id", f"{quality.VERDICT}.*")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, plan = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    sources = spark.createDataFrame([(s, int(plan.sizes[s]), float(t)) for s, t in plan.targets.items()], "source string, source_size long, target double")
    rows = taken.select("doc_id", "size", F.get("sources", F.lit(0)).alias("_source"), "taken")
    found = rows.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("source")))  # one row a source; their number is checked
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(urls.seeded_labels(pages)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents")).drop("key")
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.page_rows(warc.read(spark, folder))


def op9_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orc")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return orc_tokens.digests(spark, path)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op12_lexrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.prepared(moved), F.col("id") % 50 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_tiff": op3_tiff,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_urls": op6_urls,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_orc": op9_orc,
    "op10_bpe": op10_bpe,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexrank": op12_lexrank,
    "op13_negatives": op13_negatives,
}

_TERMS_SQL = rf"unnest(regexp_extract_all(translate(text, '{lexrank.UPPER}', '{lexrank.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

#: The others' rows depend on hashes, models or files that SQL can't express; tests/llm holds the brute-force versions.
ORACLE_SQL = {
    "op12_lexrank": f"""WITH postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS_SQL} FROM documents) GROUP BY 1, 2),
  lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY 1),
  corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
  weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
  asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS_SQL} FROM benchmark) GROUP BY 1, 2),
  scored AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // total)))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), corpus GROUP BY 1, 2),
  ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
  SELECT * FROM ranked WHERE rank <= 20""",
}
