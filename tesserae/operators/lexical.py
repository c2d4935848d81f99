"""Full-text candidates: BM25 over all indexed rows.

Document frequencies, the number of rows and the mean length are one aggregate row; term frequencies are computed beside each
text. So a query is one scan of texts and no shuffle of texts or postings, and the top candidates come from a bounded top-k. For
stores that are searched often, operators.postings keeps an index instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.bind import let
from tesserae.functions.text import folded, query_terms
from tesserae.plans.lineage import kept

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CANDIDATES = 100


TOKEN, NO_TOKEN = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _counts(text: Column, terms: list[list[str]]) -> Column:
    """[number of tokens, frequency of each term] of a folded text, by counting matches, without making its tokens.

    Terms of one token are found in one pass, which texts without any of them skip; a phrase is counted wherever its first token
    is followed by the others.
    """
    single = [t[0] for t in terms if len(t) == 1]
    any_of = reduce(lambda a, b: a | b, (text.contains(t) for t in single), F.lit(False))
    whole = rf"(?<!{TOKEN})({'|'.join(single)})(?!{TOKEN})"
    hits = F.when(any_of, F.regexp_extract_all(text, F.lit(whole), F.lit(1))).otherwise(F.array().cast("array<string>")) if single else F.array().cast("array<string>")

    def frequency(found: Column, term: list[str]) -> Column:
        if len(term) == 1:
            return F.size(found) - F.size(F.array_remove(found, term[0]))
        rest = f"{NO_TOKEN}+".join(term[1:])
        return F.when(text.contains(term[0]), F.regexp_count(text, F.lit(rf"(?<!{TOKEN}){term[0]}(?={NO_TOKEN}+{rest}(?!{TOKEN}))"))).otherwise(0)

    return let(hits, lambda found: F.array(F.regexp_count(text, F.lit(f"{TOKEN}+")), *(frequency(found, t) for t in terms)))


def _bm25(counted: DataFrame, terms: list[list[str]]) -> DataFrame:
    """Rows of counted, with _c as of _counts, that hold any of the terms, and bm25."""
    of = lambda k: F.get("_c", F.lit(k))
    places = range(1, len(terms) + 1)
    corpus = counted.select("_c").agg(F.count(F.lit(1)).alias("_n"), F.avg(of(0)).alias("_avg"), *(F.count_if(of(k) > 0).alias(f"_df{k}") for k in places))
    hits = counted.where(F.array_max(F.slice("_c", 2, len(terms))) > 0).crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for k in places:
        df, tf = F.col(f"_df{k}"), of(k)
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * of(0) / F.col("_avg")))
    return hits.withColumn("bm25", score)


def _counts_of(text: str, terms: list[list[str]]) -> Column:
    return let(folded(F.coalesce(F.col(text), F.lit(""))), lambda t: _counts(t, terms))


def scored(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """rows that hold any term of the query, with bm25 (negative; the lower the better).

    rows are all that is indexed: they define document frequencies and mean length, whatever is filtered later.
    """
    terms = query_terms(query)
    if not terms:
        return rows.withColumn("bm25", F.lit(0.0)).where(F.lit(False))
    return _bm25(rows.withColumn("_c", _counts_of(text, terms)), terms).select(*rows.columns, "bm25")


def candidates(rows: DataFrame, query: str, limit: int = CANDIDATES, where: Column | None = None, text: str = "content") -> DataFrame:
    """(id, bm25) of the best rows that pass where; scores equal to nine places are ties, ordered by id.

    Texts are read once: their ids and counts, some bytes a row, are kept, and statistics and scores come from these.
    """
    terms = query_terms(query)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("bm25")).where(F.lit(False))
    seen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    counted = kept(rows.select("id", seen.alias("_seen"), _counts_of(text, terms).alias("_c")))
    return _bm25(counted, terms).where("_seen").select("id", "bm25").orderBy(F.round("bm25", 9), "id").limit(limit)
