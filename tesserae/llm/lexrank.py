"""Ranked lexical search: a stored table of postings, joined with the items' terms, summed, and the best of each item kept.

Postings (bucket, slice, term, doc_id, row, tf, n) lie in folders by bucket, a hash of the term, sorted by term, so that a reader
of few terms opens few buckets. A term's documents are dealt over slices, so no term's postings meet in one task. A marker of
each document with terms, in a bucket of its own, gives the number of documents and of terms without another scan of texts.

Each row of documents is a document: row numbers it, since doc_id may be null or repeated. To rank, the postings of the
asked terms are dealt by document; each meets the items that ask for it, and the scores of an item and document are
summed where they lie; a task hands on only its own best of each item. The items' terms are broadcast while they are
few (MOST_BROADCAST, counted), else joined by term and slice.

Defined results: a null text has no terms; rows of one item_id are one item with the terms of all of them; an item of no known
term has no rows; a null doc_id ranks first among equal scores. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import let, scratch, text_of

#: Letters, digits and all that is not ASCII; A-Z are lower-cased first. As a negated class Java takes six times as long.
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, MARKERS, TOP = 32, -1, 20
#: Rows of a slice: a term's postings are dealt over one slice for so many documents, and over SLICES at least.
SLICES, SLICE_ROWS = 4, 2_000_000
#: Rows of items' terms, some 50 bytes each, that are broadcast at most.
MOST_BROADCAST = 500_000


def terms(text: Column) -> Column:
    """Terms of a text in order, repeats included."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def frequencies(found: Column) -> Column:
    """(term, tf) of an array of terms: runs of the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).alias("tf"))))

    return let(F.sort_array(found), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:int>>")))


def asked_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term, q): how often an item asks for a term."""
    return items.select("item_id", F.explode(terms(text_of(items, text))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def bucket_of(term: Column) -> Column:
    return F.when(term.isNull(), MARKERS).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def write_postings(docs: DataFrame, path: str, only: DataFrame | None = None, text: str = "text", slices: int = SLICES) -> None:
    """Writes the postings of docs; only(term): of these terms alone, left out before anything is shuffled if they are few."""
    counted = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), terms(text_of(docs, text)).alias("_t"))
    every = counted.select("doc_id", "row", F.size("_t").cast("long").alias("n"), F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))), frequencies(F.col("_t")))).alias("p"))
    rows = every.where("n > 0").select("doc_id", "row", "n", "p.term", F.col("p.tf").cast("long").alias("tf"))
    if only is not None:
        known = only.select("term").distinct().withColumn("_asked", F.lit(True))
        few = known.count() <= MOST_BROADCAST
        rows = rows.join(F.broadcast(known) if few else known, "term", "left").where("_asked or term is null").drop("_asked")
    rows = rows.withColumns({"bucket": bucket_of(F.col("term")), "slice": F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")})
    rows.repartition("bucket", "slice").sortWithinPartitions("bucket", "term", "row").write.partitionBy("bucket").parquet(path)


def statistics(postings: DataFrame) -> tuple[int, int]:
    """The number of documents with terms, and of all their terms."""
    n, total = postings.where(F.col("bucket") == MARKERS).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n, total


def weights(postings: DataFrame, n_docs: int) -> DataFrame:
    """(term, w) of the terms in postings."""
    df = postings.where(F.col("bucket") != MARKERS).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w"))


def top(postings: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, limit: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the limit best documents of each item of asked(item_id, term, q)."""
    wanted = asked.join(weights(postings, n_docs), "term").where("w > 0").select("item_id", "term", (F.col("q") * F.col("w")).alias("qw"))
    few = asked.count() <= MOST_BROADCAST
    buckets = [r[0] for r in asked.select(bucket_of(F.col("term"))).distinct().collect()]  # BUCKETS at most
    m = f"(75 + ((25 * n * {n_docs}L) div {max(1, n_terms)}L))"
    rows = postings.where(F.col("bucket").isin(buckets)).select("term", "doc_id", "row", "slice", F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})").alias("s"))
    if few:
        met = rows.repartition("row").join(F.broadcast(wanted), "term")
    else:  # an item's terms go to each slice of their postings
        slices = rows.agg(F.max("slice")).first()[0] or 0
        met = rows.join(wanted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices)))), ["term", "slice"])
    found = met.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("qw") * F.col("s")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", limit: int = TOP) -> DataFrame:
    """top over the postings of docs that items ask for, which are written to the shared folder."""
    spark, path, needed = docs.sparkSession, scratch(docs.sparkSession, "postings"), scratch(docs.sparkSession, "asked")
    asked_terms(items, text).write.parquet(needed)
    asked = spark.read.parquet(needed)
    write_postings(docs, path, asked, text)
    postings = read(spark, path)
    return top(postings, asked, *statistics(postings), limit)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, row long, n long, term string, tf long, slice int, bucket int").parquet(path)
