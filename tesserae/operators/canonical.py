"""Canonical preferences: winners by key, duplicate ranks, versions of a key, timelines, preference candidates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import preference_score
from tesserae.plans.scope import active

MAX_POOL = 500
PRIORITY = {"session": 3, "project": 2, "global": 1}


def priority():
    out = F.lit(0)
    for name, value in PRIORITY.items():
        out = F.when(F.col("scope_type") == name, value).otherwise(out)
    return out


def winners(rows: DataFrame) -> DataFrame:
    """One row a key: the most specific scope, then the newest. Ids are found first, and then their rows."""
    order = F.struct(-priority(), -F.unix_micros("updated_at"), "id")
    best = rows.where(F.col("canonical_key").isNotNull()).groupBy("canonical_key").agg(F.min_by("id", order).alias("id"))
    return rows.join(best.select("id"), "id", "left_semi")


def duplicate_ranks(rows: DataFrame) -> DataFrame:
    """dup_rank of each active row within its scope and key; rows above 1 are superseded."""
    order = Window.partitionBy("scope_type", F.coalesce("scope_id", F.lit("")), "canonical_key").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    live = rows.where(F.col("deleted_at").isNull() & F.col("canonical_key").isNotNull())
    return live.withColumn("dup_rank", F.row_number().over(order))


def versions(rows: DataFrame) -> DataFrame:
    """Writes on one scope and key in the order of seq, numbered by version: a version begins where the content changes.

    A deletion between two writes (deleted_at on the earlier one) also begins a new version.
    """
    by = Window.partitionBy("scope_type", F.coalesce("scope_id", F.lit("")), "canonical_key").orderBy("seq")
    keyed = rows.where(F.col("canonical_key").isNotNull())
    changed = ~F.lag("content_hash").over(by).eqNullSafe(F.col("content_hash")) | F.lag("deleted_at").over(by).isNotNull()
    return keyed.withColumn("_new", changed.cast("int")).withColumn("version", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def timeline(rows: DataFrame, keys: list[str] | None, now: datetime, limit: int | None = 50) -> DataFrame:
    """All versions of the keys, deleted ones too, expired ones not: by key, active first, newest first."""
    shown = rows.where(F.col("canonical_key").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))
    if keys is not None:
        shown = shown.where(F.col("canonical_key").isin(keys))
    order = ["canonical_key", F.col("deleted_at").isNotNull(), F.desc("updated_at"), "id"]
    return shown.orderBy(*order).limit(limit) if limit else shown.withColumn("place", F.row_number().over(Window.partitionBy("canonical_key").orderBy(*order[1:])))


def preference_candidates(rows: DataFrame, terms: list[str], now: datetime, pool: int = 200) -> DataFrame:
    """The pool newest active rows with a key, with match, the number of terms in key and content.

    Where any row matches two terms, those with two or more stay; else where any matches one, those with one or more; else all.
    """
    newest = rows.where(active(now) & F.col("canonical_key").isNotNull()).orderBy(F.desc("updated_at"), "id").limit(max(1, min(MAX_POOL, pool)))
    scored = newest.withColumn("match", preference_score(F.col("canonical_key"), F.col("content"), terms))
    best = scored.withColumn("_best", F.max("match").over(Window.partitionBy()))  # at most pool rows
    return best.where(F.col("match") >= F.least(F.lit(2), F.col("_best"))).withColumn("effective", F.least(F.lit(0.99), 0.8 + 0.05 * F.col("match"))).drop("_best")


def preferred(rows: DataFrame, terms: list[str], now: datetime, found: DataFrame | None = None) -> DataFrame:
    """What replaces the result found(id, score, rank, ...) of a search for a preference: rows with match, effective, rank.

    Winners by key among the preference candidates and those found rows that have a canonical tag or a key of their own; best match
    first, then the better score, scope and age. A candidate's effective score is at least its score in found. Without any
    winner, found stays as it is.
    """
    candidates = preference_candidates(rows, terms, now)
    if found is None:
        pool = candidates.withColumn("_place", F.lit(None).cast("int"))
    else:
        shared = [c for c in rows.columns if c in found.columns]
        scores = found.select("id", F.col("score").alias("_score"), F.col("rank").alias("_place"))
        own = candidates.join(F.broadcast(scores), "id", "left").withColumn("effective", F.greatest("effective", "_score"))
        rest = found.select(*shared, F.lit(0).alias("match"), F.col("score").alias("effective"), F.col("rank").alias("_place"))
        pool = own.select(rest.columns).unionByName(rest.join(own.select("id"), "id", "left_anti"))
    own_key = F.col("canonical_key").isNotNull() & (F.col("match").isNotNull())
    pool = pool.withColumn("_is", own_key)
    order = Window.orderBy(F.desc("match"), F.desc("effective"), priority().desc(), F.desc("updated_at"), "id")  # at most pool + MAX_LIMIT rows
    by_key = Window.partitionBy("canonical_key").orderBy(priority().desc(), F.desc("updated_at"), "id")
    won = pool.where("_is").withColumn("_r", F.row_number().over(by_key)).where("_r = 1").withColumn("rank", F.row_number().over(order))
    if found is None:
        return won.drop("_r", "_is", "_place")
    none = won.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").drop("_n")
    as_found = pool.crossJoin(F.broadcast(none)).withColumn("_r", F.lit(1)).withColumn("rank", F.col("_place"))  # one row or none
    return won.unionByName(as_found.select(won.columns)).drop("_r", "_is", "_place")
