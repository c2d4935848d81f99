"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, mixing, neardup, pii, quality
from tesserae.llm.common import scratch, trusted_ids, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.fit(docs, trusted_ids(spark, sf_dir))
    return quality.judge(docs, model).where(f"{quality.VERDICT}.kept").drop(quality.VERDICT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the shingles of five words), that of the smallest id."""
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, at most three times."""
    return mixing.apply(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of ids and of the text decoded from them, a row for each copy in the mix."""
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mix),
    ("BPE", encode),
]

#: Fingerprints, fitted weights and BPE are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(path := scratch(spark, f"stage{k}"))
            out = spark.read.parquet(path)
        docs = out
    return docs
