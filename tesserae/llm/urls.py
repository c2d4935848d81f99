"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features are column expressions: lengths, path depth, digit ratio, character entropy, parameter and hyphen counts, and the
smoothed share of blocked URLs among labelled ones with the same host suffix (of one, two and three labels) and file suffix.
The trees are Spark ML's, fitted on a bounded sample of labelled URLs (about max_labelled, those of smallest hash), so all
work stays in the JVM. Labels are the caller's; where there are none, seeded_labels gives examples.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule, and is judged by its features (all
zero for null). Repeated rows are judged alike. With labels of one class only, every verdict of the method is that
class; without labels it is "allow". An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, hashed_sample

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Host words of the usual categories of blocklists (adult, gambling, pharmacy, spam and malware, advertising and tracking).
SEED_WORDS = (
    "adult", "porn", "sex", "xxx", "escort", "nude", "cam", "bet", "bets", "betting", "bingo", "casino", "gambling", "jackpot", "lottery", "poker", "slots",
    "pharma", "pharmacy", "pills", "drugs", "viagra", "cialis", "meds", "crack", "keygen", "malware", "phishing", "scam", "spam", "torrent", "virus", "warez",
    "ad", "ads", "adserver", "adtrack", "banner", "click", "clicks", "popup", "tracker", "tracking", "loan", "loans", "payday", "replica",
)
#: Folds of hosts for the shares of training URLs.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens")
SUFFIXES = ("suffix1", "suffix2", "suffix3", "file_suffix")


def _rest(url: Column) -> Column:
    """What follows the first "://", null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest))


def with_features(urls: DataFrame) -> DataFrame:
    """urls(url, ...) with _host, _path, the lexical features and the suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = urls.withColumn("_host", host(F.col("url"))).withColumn("_path", path(F.col("url")))
    h, p, n = F.col("_host"), F.col("_path"), F.length(url)
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    last = lambda k: F.substring_index(h, ".", -k)
    return rows.withColumns({
        "url_length": n.cast("double"), "host_length": F.length(h).cast("double"), "path_length": F.length(p).cast("double"),
        "depth": F.regexp_count(p, F.lit("/[^/]")).cast("double"), "host_labels": F.when(h == "", 0).otherwise(F.size(F.split(h, r"\."))).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"), "hyphens": F.regexp_count(h, F.lit("-")).cast("double"),
        "suffix1": last(1), "suffix2": last(2), "suffix3": last(3), "file_suffix": F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1),
    })


@dataclass(frozen=True)
class UrlModel:
    """trees: None with labels of one class; shares: (kind, suffix, share) table, which stays in the JVM; base: share of blocked labels."""

    trees: GBTClassificationModel | None
    shares: DataFrame | None
    base: float


def _with_shares(rows: DataFrame, shares: DataFrame, base: float, fold: str | None = None) -> DataFrame:
    """rows with a share column for each kind of suffix; with fold, the share of the other folds' URLs."""
    for kind in SUFFIXES:
        # at most one row a labelled URL, so the tables are bounded as the sample is
        own = shares.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.col("share").alias(f"{kind}_share"), *([F.col("fold").alias(fold)] if fold else []))
        rows = rows.join(F.broadcast(own), [kind, *([fold] if fold else [])], "left").withColumn(f"{kind}_share", F.coalesce(f"{kind}_share", F.lit(base)))
    return VectorAssembler(inputCols=[*LEXICAL, *(f"{k}_share" for k in SUFFIXES)], outputCol="_features").transform(rows)


def fit(labelled: DataFrame, max_labelled: int = 20_000, rounds: int = 12, depth: int = 3, prior: float = 20.0, seed: int = 5) -> UrlModel:
    """Trees from labelled(url, label), label 1 for blocked; about max_labelled distinct URLs, those of smallest hash, define them.

    A training URL's suffix shares come from the URLs of other hosts only (FOLDS folds by host), so that no label stands
    in its own features.
    """
    rows = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max(F.col("label").cast("double")).alias("label"))
    rows = cut(with_features(hashed_sample(rows, "url", max_labelled)).withColumn("_fold", F.pmod(F.xxhash64("_host"), F.lit(FOLDS)).cast("int")))
    n, base = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or base in (0.0, 1.0):
        return UrlModel(None, None, base or 0.0)
    stacked = rows.select("label", "_fold", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES))).alias("s"))
    counts = cut(stacked.groupBy("s.kind", "s.suffix", F.col("_fold").alias("fold")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("kind", "suffix").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    smooth = lambda bad, n: (bad + prior * base) / (n + prior)
    others = counts.join(totals, ["kind", "suffix"]).withColumn("share", smooth(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_blocked", maxIter=rounds, maxDepth=depth, maxBins=64, seed=seed, stepSize=0.3)
    model = trees.fit(_with_shares(rows, others, base, "_fold").coalesce(1))
    return UrlModel(model, totals.withColumn("share", smooth(F.col("all_bad"), F.col("all_n"))), base)


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    rows = with_features(pages.select("page_id", "url"))
    if model.trees is None:
        rows = rows.withColumn("_blocked", F.lit(model.base))
    else:
        rows = model.trees.transform(_with_shares(rows, model.shares, model.base))
    own = F.when(F.col("_blocked") > 0.5, "block").otherwise("allow")
    rule = F.col("_rule")
    return rows.withColumn("_rule", first_rule(F.col("_host"), F.col("_path"), rules)).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule["rule"].alias("rule"), F.coalesce(rule["verdict"], own).alias("verdict")
    )


def seeded_labels(pages: DataFrame, words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """(url, label) of all pages where no labels are at hand: 1 if a word of the host, between dots and hyphens, is a seed word.

    These are positive and unlabelled examples: the others count as 0, though some may be bad.
    """
    parts = F.split(host(F.col("url")), "[.-]")
    return pages.where("url is not null").select("url", F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("int").alias("label"))
