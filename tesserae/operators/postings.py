"""A stored index of terms: blocks of postings by bucket of term, in generations, and the ids of rows that are gone.

A posting is (term, number, n, positions): the tokens' places in a row of n tokens. A block holds the postings of one term in some rows, a generation
the blocks of one write, in folders by a hash of the term; a query opens its terms' folders only. Rows have numbers there, which take
a few bits where they are sorted; what ids and scopes the numbers stand for lies once beside the blocks, by range of number, and is looked up for
hits only. Ids that are gone are dropped then. The numbers of rows and tokens are counted when rows come and go, so no query scans for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import query_terms, tokens
from tesserae.operators.lexical import B, K1, LEAST_IDF
from tesserae.operators.merge import of_ids

SCHEMA = "term string, ids array<long>, lengths array<int>, positions array<array<int>>, places int"
NUMBERS = "number long, id string, scope_type string, scope_id string"
#: Folders of terms; numbers of one folder and of one merged block, as powers of 2.
BUCKETS, RANGE, BLOCK = 64, 18, 14
#: Rows that one task indexes, about, and tokens that it holds at once, unless one row has more.
ROWS, TOKENS = 2_000, 1_000_000
#: Seed of Spark's xxhash64.
SEED = 42
#: How blocks are written: sorted numbers and places as differences.
WRITTEN = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def buckets_of(df: DataFrame, terms: list[str]) -> list[int]:
    """Buckets of a query's terms."""
    spark = df.sparkSession
    return [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"))).distinct().collect()]


def _blocks(part: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of rows (id, tokens), by term and then id."""
    from xxhash import xxh64_intdigest

    part = part.take(pc.sort_indices(part.column(0)))
    lists = part.column(1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = code * max(1, len(lengths)) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    first = starts(key)  # of each posting, among places
    term, at = key[first] // max(1, len(lengths)), key[first] % max(1, len(lengths))
    block = starts(term)  # of each block, among postings
    of = np.fromiter((xxh64_intdigest(names[k], SEED) % BUCKETS for k in term[block]), np.int32, len(block))  # BUCKETS is a power of 2: as bucket, of the unsigned hash
    ends = lambda x, n: pa.array(np.append(x, n).astype(np.int32))
    positions = pa.ListArray.from_arrays(ends(first, len(key)), pa.array(place[order].astype(np.int32)))
    lists = [pa.ListArray.from_arrays(ends(block, len(first)), x) for x in (part.column(0).take(pa.array(at)), pa.array(lengths[at].astype(np.int32)), positions)]
    places = np.diff(np.append(first[block], len(key))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(of), coded.dictionary.take(pa.array(term[block])), *lists, pa.array(places)], ["_bucket", "term", "ids", "lengths", "positions", "places"])


def packed(rows: DataFrame) -> DataFrame:
    """Blocks, with their _bucket, of rows(id, content), whose ids may be numbers. They are made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            so_far, k = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while k < b.num_rows:
                end = max(k + 1, int(np.searchsorted(so_far, (so_far[k - 1] if k else 0) + TOKENS, "right")))
                yield _blocks(b.slice(k, end - k))
                k = end

    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.select("id", tokens(F.coalesce("content", F.lit(""))).alias("_t"))
    return cut.mapInArrow(run, f"_bucket int, term string, ids array<{kind}>, lengths array<int>, positions array<array<int>>, places int")


def unpacked(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, with their _bucket if they have it."""
    kept = [c for c in ("_bucket", "term") if c in blocks.columns]
    each = blocks.select(*kept, F.explode(F.arrays_zip("ids", "lengths", "positions")).alias("_e"))
    return each.select(*kept, F.col("_e.ids").alias("id"), F.col("_e.lengths").alias("n"), F.col("_e.positions").alias("positions"))


def repacked(found: DataFrame) -> DataFrame:
    """Blocks, with their _bucket, of postings whose ids are numbers. Those of a term are dealt out and put together by range of number."""
    rows = found.withColumns({"_bucket": bucket(F.col("term")), "_block": F.shiftright("id", BLOCK)}).repartition("_bucket", "_block")
    each = F.array_sort(F.collect_list(F.struct("id", "n", "positions"))).alias("_e")
    rows = rows.groupBy("_bucket", "_block", "term").agg(each, F.sum(F.size("positions")).cast("int").alias("places"))
    return rows.select("_bucket", "term", F.col("_e.id").alias("ids"), F.col("_e.n").alias("lengths"), F.col("_e.positions").alias("positions"), "places")


def counts(rows: DataFrame) -> tuple[int, int]:
    """The number of rows and of their tokens."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(tokens(F.coalesce("content", F.lit(""))))), F.lit(0))).first()
    return n, total


def without(rows: DataFrame, gone: DataFrame | None, n_gone: int) -> DataFrame:
    if gone is None or n_gone == 0:
        return rows
    return of_ids(rows, gone, "left_anti", n_gone)


def hits(found: DataFrame, query: str) -> tuple[list[list[str]], DataFrame]:
    """The query's terms, and (number, n, _tf) of the rows that hold a token of them, gone ones too, from its tokens' postings; _tf: each term's occurrences."""
    terms = query_terms(query)
    names = {t: f"_p{k}" for k, t in enumerate(dict.fromkeys(x for term in terms for x in term))}
    none = F.array().cast("array<int>")
    rows = found.groupBy(F.col("id").alias("number"), "n").agg(*(F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), True), none).alias(c) for t, c in names.items()))

    def frequency(term: list[str]) -> Column:
        first = F.col(names[term[0]])
        if len(term) == 1:
            return F.size(first)

        def followed(p: Column) -> Column:
            out = F.lit(True)
            for k, t in enumerate(term[1:], 1):
                out = out & F.array_contains(F.col(names[t]), p + k)
            return out

        return F.size(F.filter(first, followed))

    rows = rows.select("number", "n", F.array(*map(frequency, terms)).alias("_tf"))
    return terms, rows.where(F.array_max("_tf") > 0)


def scored(rows: DataFrame, n_terms: int, n_rows: int, n_tokens: int) -> DataFrame:
    """(id, scope_type, scope_id, bm25) of hits(id, scope_type, scope_id, n, _tf) that are not gone.

    As lexical.scored: a term with underscores is a phrase, whose tokens have to follow each other.
    """
    tf = lambda k: F.get("_tf", F.lit(k))
    places = range(n_terms)
    corpus = rows.agg(*(F.count_if(tf(k) > 0).alias(f"_df{k}") for k in places))
    rows = rows.crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for k in places:
        df = F.col(f"_df{k}")
        idf = F.log((n_rows - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * (tf(k) * (K1 + 1)) / (tf(k) + K1 * (1 - B + B * F.col("n") / (n_tokens / n_rows)))
    return rows.select("id", "scope_type", "scope_id", score.alias("bm25"))
