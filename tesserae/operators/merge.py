"""Writes that read and change only what a batch touches, and tell what became of each write.

A batch touches a live row of its scope by equal content or by equal key; a touched row's own content and key touch others in turn
(closure). These rows and the batch go through the windows of ingest.versions, all others are passed by. Finding the touched
rows reads four narrow columns of the store.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import ingest
from tesserae.plans.lineage import kept

#: Rounds after which the closure gives up; a consistent store needs three: a live row of each key, and one of each content and key.
MOST_ROUNDS = 20


def of_ids(rows: DataFrame, ids: DataFrame, how: str, n: int | None = None) -> DataFrame:
    """ingest.few_out by id."""
    return ingest.few_out(rows, ids, "id", how, n)


class Written(NamedTuple):
    """rows: the touched rows as they are now, and new ones (contents are looked up anew at each use); touched(id): the stored rows they stand for; outcome: one row a write
    (seq, idempotency_key, id, created, redacted, canonical_key, expires_at, replaced_ids, replay); keys: the bindings after the batch; sources: what ingest.filled makes rows from."""

    rows: DataFrame
    touched: DataFrame
    outcome: DataFrame
    keys: DataFrame
    sources: tuple[DataFrame, DataFrame, DataFrame]

    def store(self, before: DataFrame) -> DataFrame:
        """The whole store after the batch."""
        given = before if "metadata" in before.columns or "metadata" not in self.rows.columns else before.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        return of_ids(given, self.touched, "left_anti").select(self.rows.columns).unionByName(self.rows)


def closure(live: DataFrame, ready: DataFrame) -> DataFrame:
    """(id) of the live rows that ready(scope_type, scope_id, content_hash, canonical_key) touches."""
    scope = ["scope_type", F.coalesce("scope_id", F.lit("")).alias("scope")]
    narrow = live.select("id", *scope, "content_hash", "canonical_key")
    by = lambda df, c: df.where(F.col(c).isNotNull()).select("scope_type", "scope", c).distinct()
    edge, found = ready.select(*scope, "content_hash", "canonical_key"), None
    for _ in range(MOST_ROUNDS):
        hits = narrow.join(by(edge, "content_hash"), ["scope_type", "scope", "content_hash"], "left_semi").unionByName(narrow.join(by(edge, "canonical_key"), ["scope_type", "scope", "canonical_key"], "left_semi"), allowMissingColumns=True)
        hits = hits.select(narrow.columns).dropDuplicates(["id"])
        edge = kept(hits if found is None else hits.join(found, "id", "left_anti"))
        if edge.isEmpty():
            break
        found = edge.select("id") if found is None else kept(found.union(edge.select("id")))
    else:
        raise ValueError(f"contents and keys of the store are still linked to others after {MOST_ROUNDS} rounds")
    return edge.select("id") if found is None else found


def replays(ready: DataFrame, store: DataFrame, keys: DataFrame) -> DataFrame:
    """(seq, id, expires_at, canonical_key) of writes whose idempotency key points to a live row of the same scope and content."""
    live = store.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"), F.col("scope_type").alias("_t"), F.col("scope_id").alias("_s"), F.col("content_hash").alias("_h"), F.col("expires_at").alias("_x"), F.col("canonical_key").alias("_k"))
    asked = ready.where(F.col("idempotency_key").isNotNull()).select("seq", "idempotency_key", "scope_type", "scope_id", "content_hash")
    bound = ingest.latest_bindings(keys).select("key", "memory_id").join(asked, F.col("key") == F.col("idempotency_key"))
    same = (F.col("scope_type") == F.col("_t")) & F.col("scope_id").eqNullSafe(F.col("_s")) & (F.col("content_hash") == F.col("_h"))
    return bound.drop("key").join(live, "memory_id").where(same).select(F.col("seq"), F.col("memory_id").alias("id"), F.col("_x").alias("expires_at"), F.col("_k").alias("canonical_key"))


def write(store: DataFrame, batch: DataFrame, keys: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> Written:
    """The batch (as for ingest.upsert, seq unique) written to the store; keys(key, memory_id, seq): bindings of idempotency keys so far.

    Equals ingest.upsert without the replays. expires_at is the row's after the whole batch. Writes whose content is empty after
    redaction have no outcome. keep: puts aside what has a row a write, contents too.
    """
    spark = batch.sparkSession
    keys = spark.createDataFrame([], "key string, memory_id string, seq long") if keys is None else keys.select("key", "memory_id", "seq")
    store, ready, columns = ingest._aligned(store, ingest.normalized(batch))
    ready = keep(ready)
    again = kept(replays(ready, store, keys).join(ready.select("seq", "idempotency_key", "redacted"), "seq"))
    fresh = ingest.few_out(ready, again.select("seq"), "seq")
    live = store.where(F.col("deleted_at").isNull())
    touched = kept(closure(live, fresh))
    hit = of_ids(live, touched, "left_semi")
    writes, merged = ingest.versions(hit, fresh, columns)
    merged = keep(merged)
    same = None
    for c in ingest.GROUP:
        equal = F.col(f"w.{c}").eqNullSafe(F.col(f"m.{c}"))
        same = equal if same is None else same & equal
    placed = writes.where(~F.col("_stored")).select("seq", "_order", *ingest.GROUP).alias("w").join(merged.select("id", "expires_at", "_stored", "_begun", "_entry", "_previous", *ingest.GROUP).alias("m"), same)
    replaced = F.when((F.col("w._order") == F.col("m._entry")) & F.col("m._previous").isNotNull(), F.array("m._previous")).otherwise(F.array().cast("array<string>"))
    placed = placed.select("w.seq", "m.id", (~F.col("m._stored") & (F.col("w._order") == F.col("m._begun"))).alias("created"), "m.canonical_key", "m.expires_at", replaced.alias("replaced_ids"), F.lit(False).alias("replay"))
    told = ["seq", "idempotency_key", "id", "created", "redacted", "canonical_key", "expires_at", "replaced_ids", "replay"]
    outcome = placed.join(ready.select("seq", "idempotency_key", "redacted"), "seq").select(told)
    outcome = kept(outcome.unionByName(again.withColumns({"created": F.lit(False), "replaced_ids": F.array().cast("array<string>"), "replay": F.lit(True)}).select(told)))
    bound = outcome.where(F.col("idempotency_key").isNotNull() & ~F.col("replay")).select(F.col("idempotency_key").alias("key"), F.col("id").alias("memory_id"), "seq")
    later = ingest.latest_bindings(bound).withColumn("_new", F.lit(True))
    all_keys = keys.withColumn("_new", F.lit(False)).unionByName(later)  # a new binding stands whatever its seq
    latest = all_keys.groupBy("key").agg(F.max_by("memory_id", F.struct("_new", "seq")).alias("memory_id"), F.max_by("seq", F.struct("_new", "seq")).alias("seq"))
    return Written(ingest.filled(merged, hit, fresh).select(*columns), touched, outcome, latest, (merged, hit, fresh))
