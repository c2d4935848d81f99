"""Quality rules: base rules and a log-likelihood ratio of hashed n-grams.

A document's unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the
buckets are estimated: the target, from trusted documents, and the raw corpus, from all documents. The
score is the sum of log(target / raw) over the document's n-grams, divided by their number plus a
constant that pulls short texts towards 0. A document is kept if the base rules pass and the score
reaches the threshold, which trusted documents outside the target have set. Everything here is DataFrame expressions; the only data on the driver is one
weight for each bucket.

Defined results: a null text is an empty text (0 words, base_failed, not kept). A null doc_id gives a row as
any other. Repeated rows are judged one by one, with equal results. Without trusted documents, or with
an empty corpus, every weight is 0, so every score is 0 and only the base rules reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import hashed_sample, let, text_of, words

#: Words in a window of the repetition rule.
WINDOW = 8
#: The column that judge adds.
VERDICT = "_quality_verdict"


@dataclass(frozen=True)
class QualityModel:
    """weights: log(target / raw) of each bucket; kept from threshold on."""

    weights: tuple[float, ...]
    threshold: float
    shrink: float


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _pair(h: Column, i: Column) -> Column:
    return F.xxhash64(F.get(h, i), F.get(h, i + 1))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _up_to(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_buckets(h: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams; h: the words' hashes."""
    return F.concat(
        F.transform(h, lambda x: _bucket(x, buckets)),
        F.transform(_up_to(F.size(h) - 1), lambda i: _bucket(_pair(h, i), buckets)),
    )


def repeated_words(h: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more; h: the words' hashes.

    Texts whose windows all differ, nearly all, stop at the count of distinct windows.
    """
    windows = F.transform(_up_to(F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(v: Column) -> Column:
        by_hash = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda e, i: (F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"])
            return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(twin(e, i), F.lit(False))), lambda e: e["i"]))

        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(let(by_hash, starts), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda acc: acc["n"])

    return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = 10_000, max_trusted: int = 50_000, smoothing: float = 1.0, shrink: float = 60.0, low: float = 0.01, spread: float = 2.0, least: int = 20) -> QualityModel:
    """Bucket weights and threshold from docs(doc_id, text) and trusted(doc_id).

    max_trusted bounds the trusted documents (about as many of smallest hash are taken, so that a rerun takes the same); the
    raw multinomial covers every document. Half of the trusted documents define the target. The other half, scored as any
    document that the target has not seen, sets the threshold: spread times as far below their median as their
    quantile low is. With under least such documents nothing is rejected by score.
    """
    ids = hashed_sample(trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", max_trusted)
    ids = F.broadcast(ids.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("_seen")))
    rows = docs.select("doc_id", text_of(docs).alias("_text")).join(ids, "doc_id", "left")
    grams = rows.select(F.coalesce(F.col("_seen").cast("int"), F.lit(0)).alias("t"), F.explode(let(_hashes(words(F.col("_text"))), lambda h: gram_buckets(h, buckets))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect()  # one row a bucket
    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for r in counts:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["target"]
    if sum(target) == smoothing * buckets:
        return QualityModel((0.0,) * buckets, -math.inf, shrink)
    shift = math.log(sum(raw) / sum(target))
    model = QualityModel(tuple(math.log(t / r) + shift for t, r in zip(target, raw)), -math.inf, shrink)
    # a condition here, not a filter: a filter on the text would be pushed below the join and judge every document
    held = judge(rows.where("not _seen").select("doc_id", "_text"), model, "_text").select(F.when(~F.col(VERDICT)["base_failed"], F.col(VERDICT)["score"]).alias("score"))
    n, mid, bottom = held.agg(F.count("score"), F.percentile("score", 0.5), F.percentile("score", low)).first()
    return replace(model, threshold=mid - spread * (mid - bottom)) if n >= least else model


def judge(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with a struct VERDICT: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), score, base_failed, kept."""
    t, buckets = text_of(docs, text), len(model.weights)
    # one literal in the plan, and a short one: plans are printed and kept by the driver
    weights = F.split(F.lit(",".join(f"{w:.6g}" for w in model.weights)), ",").cast("array<double>")
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        def of_hashes(h: Column) -> Column:
            return F.struct(
                F.aggregate(gram_buckets(h, buckets), F.lit(0.0), lambda acc, b: acc + F.get(weights, b)).alias("llr"),
                repeated_words(h).cast("long").alias("n_repeat_words"),
            )

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(_hashes(w), of_hashes).alias("h"),
        )

    symbols, lines = F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"), let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")

    def verdict(w: Column) -> Column:
        n, repeat = w["n_words"], w["h"]["n_repeat_words"]
        score = w["h"]["llr"] / (F.greatest(2 * n - 1, F.lit(0)) + F.lit(model.shrink))
        failed = (n < 20) | (100 * repeat > 30 * n)
        return F.struct(
            n.alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), lines.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
            score.alias("score"), failed.alias("base_failed"), (~failed & (score >= F.lit(model.threshold))).alias("kept"),
        )

    return docs.withColumn(VERDICT, let(let(words(t), of_words), verdict))
