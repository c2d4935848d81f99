"""The write path as batch jobs: normalise, drop replays, merge equal contents, supersede keys, bind idempotency keys.

A batch carries seq, the order of arrival; the store's rows stand before it. Nothing is sequential: replays and equal
contents are grouped, superseded rows are found by a window over a scope and key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.redact import redacted
from tesserae.functions.text import clean_tags, content_hash, trim, written_key
from tesserae.operators import facts
from tesserae.plans.lineage import kept
from tesserae.plans.scope import Scope, in_scope

SESSION_TTL_DAYS = 14
COLUMNS = ("id", "scope_type", "scope_id", "content", "content_hash", "canonical_key", "tags", "importance", "captured", "source_agent", "created_at", "updated_at", "expires_at", "deleted_at", "seq")


def normalized(batch: DataFrame) -> DataFrame:
    """batch(seq, at, idempotency_key, scope_type, scope_id, content, tags, importance, ttl_days, key, captured, source_agent), made ready.

    Contents are redacted and trimmed (empty ones fall out), hashed, given a canonical key and an expiry.
    """
    once = {"content": trim(F.col("_r.text")), "_once": F.monotonically_increasing_id()}  # a filter on this stays behind the redaction instead of doing it a second time
    rows = batch.withColumn("_r", redacted(F.coalesce("content", F.lit("")))).withColumns(once).where("content <> '' and _once >= 0")
    ttl = F.coalesce(F.col("ttl_days"), F.when(F.col("scope_type") == "session", SESSION_TTL_DAYS))
    return rows.withColumns({
        "redacted": F.col("_r.redacted"), "content_hash": content_hash(F.col("content")), "tags": clean_tags(F.coalesce("tags", F.array().cast("array<string>"))),
        "expires_at": F.col("at") + F.make_dt_interval(ttl), "scope_id": F.when(F.col("scope_type") != "global", F.col("scope_id")),
    }).withColumn("canonical_key", written_key(F.col("content"), F.col("tags"), F.col("key"), F.col("idempotency_key"))).drop("_r", "_once", "key")


#: Ids of rows, some 64 bytes each, that are broadcast at most.
MOST_BROADCAST = 500_000


def few_out(rows: DataFrame, ids: DataFrame, by: str, how: str = "left_anti", n: int | None = None) -> DataFrame:
    """rows joined left_semi or left_anti with ids(by), n of them; few of these are sent to the rows, whose contents then stay where they are."""
    n = ids.count() if n is None else n
    return rows.join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, by, how)


def latest_bindings(keys: DataFrame) -> DataFrame:
    """The last target of each idempotency key of keys(key, memory_id, seq)."""
    return keys.groupBy("key").agg(F.max_by("memory_id", "seq").alias("memory_id"), F.max("seq").alias("seq"))


def merged_metadata(maps: Column) -> Column:
    """One map of an array of maps in order: each later one's values win; null if there is none."""
    put = lambda acc, m: F.when(m.isNull(), acc).otherwise(F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m))
    known = F.filter(maps, lambda m: m.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.create_map().cast("map<string,string>"), put))


def metadata_is(name: str, value: str) -> Column:
    """Rows whose metadata hold a value."""
    return F.coalesce(F.col("metadata")[name] == value, F.lit(False))


def _row_id():
    return F.sha2(F.concat_ws("|", "scope_type", F.coalesce("scope_id", F.lit("")), "content_hash", F.col("_version").cast("string"), F.col("_first").cast("string")), 256)


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after the batch: COLUMNS, and metadata (map<string,string>) if the store or the batch has it.

    A write merges with the live row of equal content in its scope, whatever the keys of the two are: tags are united, the last given
    importance and agent count, metadata are merged, later values winning, the expiry is renewed if one was computed, and a key that only one of them has goes to
    the row. Rows with a key open a new version whenever the content differs from the version before; only a key's last version
    stays active, and the others are soft-deleted at the time of the write that replaced them. A write without a key whose
    content has been replaced makes a row of its own, which a later write may give a key.
    """
    store, ready, columns = _aligned(store, normalized(batch))
    live, ready = store.where(F.col("deleted_at").isNull()), kept(ready)
    _, merged = versions(live, ready, columns)
    return filled(merged, live, ready).select(*columns).unionByName(store.where(F.col("deleted_at").isNotNull()).select(*columns))


def _aligned(store: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Store and normalised batch, both with metadata if one has them, and the store's columns."""
    given = "metadata" in store.columns or "metadata" in ready.columns
    with_metadata = lambda df: df if not given or "metadata" in df.columns else df.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return with_metadata(store), with_metadata(ready), [*COLUMNS, *(["metadata"] if given else [])]


#: What names one row of the result.
GROUP = ("scope_type", "scope_id", "canonical_key", "content_hash", "_version")


#: Rows of a group that are put in order at once: those of a block of 2 ** BLOCK numbers of seq.
BLOCK = 14


def _scope() -> Column:
    return F.coalesce("scope_id", F.lit("")).alias("_scope")


def _in_order(lists: Column) -> Column:
    """An array of struct(o, ...), whose other fields may be maps, by o."""
    return F.array_sort(lists, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))


def _united(tags: Column) -> Column:
    """The first tags of an array of struct(o, tags)."""
    return F.slice(F.array_distinct(F.flatten(F.transform(_in_order(tags), lambda x: x["tags"]))), 1, 64)


def versions(live: DataFrame, ready: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(writes, merged): stored and new writes with the GROUP they fall in, and a row for each group, both without their contents (see filled).

    merged has columns, and of each group _stored (it holds a stored row), _begun and _entry (the writes that made it and that made it
    its key's version) and _previous (the id of the version before). Contents are not sorted and moved with the windows. One content or key
    may have any number of writes: no frame is read again for each row, and their tags and metadata are merged by blocks of seq.
    """
    given, narrow = "metadata" in columns, [c for c in columns if c != "content"]
    live = live.select(*narrow, F.col("created_at").alias("at"), F.lit(True).alias("_stored"))
    new = ready.withColumns({"id": F.lit(None).cast("string"), "created_at": F.col("at"), "updated_at": F.col("at"), "deleted_at": F.lit(None).cast("timestamp"), "_stored": F.lit(False)})
    rows = live.unionByName(new.select(*live.columns)).withColumns({"_order": F.struct(~F.col("_stored"), "seq"), "_scope": _scope()})  # stored rows first, then arrival
    content = Window.partitionBy("scope_type", "_scope", "content_hash")
    known, so_far = F.when(F.col("canonical_key").isNotNull(), F.struct("canonical_key", "_order")), (Window.unboundedPreceding, 0)
    earlier = F.last(known, True).over(content.orderBy("_order").rowsBetween(*so_far))
    coming = F.last(known, True).over(content.orderBy(F.desc("_order")).rowsBetween(*so_far))  # the next one, by a frame that only grows
    rows = rows.withColumns({"_e": earlier, "_c": coming})
    rows = rows.withColumn("_own", F.when(F.col("_e").isNull(), F.col("content_hash")))
    key = Window.partitionBy("scope_type", "_scope", "_e.canonical_key", "_own").orderBy("_order").rowsBetween(*so_far)
    lives = F.last(F.when(F.col("canonical_key").isNotNull(), F.col("content_hash")), True).over(key) == F.col("content_hash")
    rows = rows.withColumn("_lives", F.coalesce(lives & F.col("_e").isNotNull(), F.lit(False)))
    # a row that gets its key later takes its place in the key's versions only then
    rows = rows.withColumn("canonical_key", F.coalesce("canonical_key", F.when(F.col("_lives"), F.col("_e.canonical_key")), "_c.canonical_key"))
    rows = rows.withColumn("_at", F.when(~F.col("_lives") & F.col("_c").isNotNull(), F.col("_c._order")).otherwise(F.col("_order")))
    rows = rows.withColumns({"_key": F.coalesce("canonical_key", F.lit("")), "_own": F.when(F.col("canonical_key").isNull(), F.col("content_hash"))})
    scope = ["scope_type", "_scope", "_key", "_own"]  # all that follows is partitioned by these; rows without a key are no group
    by_scope = Window.partitionBy(*scope).orderBy("_at", "_order")
    changed = (F.col("canonical_key").isNotNull() & ~F.lag("content_hash").over(by_scope).eqNullSafe(F.col("content_hash"))).cast("int")
    rows = rows.withColumn("_new", changed).withColumn("_version", F.sum("_new").over(by_scope.rowsBetween(*so_far)))
    order, entered = F.col("_order"), F.when(F.col("_at") == F.col("_order"), F.col("at"))
    last_of = lambda c, null=False: F.max(F.struct(order.alias("o"), F.col(c)) if null else F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c)))).alias(f"_{c}")
    blocks = rows.groupBy(*scope, *(c for c in GROUP if c not in scope), F.shiftright("seq", BLOCK).alias("_block"), "_stored").agg(
        F.min(F.struct(order.alias("o"), "id")).alias("_id"), _united(F.collect_list(F.struct(order.alias("o"), "tags"))).alias("tags"),
        *([merged_metadata(F.transform(_in_order(F.collect_list(F.struct(order.alias("o"), "metadata"))), lambda x: x["metadata"])).alias("metadata")] if given else []),
        last_of("importance"), last_of("captured"), last_of("source_agent", True), last_of("expires_at"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.min(entered).alias("_entered"),
        F.min("seq").alias("_first"), F.max("seq").alias("seq"), F.min(order).alias("_begun"), F.min("_at").alias("_entry"),
    )
    of_block, latest = F.col("_begun").alias("o"), lambda c: F.max(f"_{c}")[c].alias(c)
    merged = blocks.groupBy(*scope, *(c for c in GROUP if c not in scope)).agg(
        F.min("_id")["id"].alias("id"), _united(F.collect_list(F.struct(of_block, "tags"))).alias("tags"),
        *([merged_metadata(F.transform(_in_order(F.collect_list(F.struct(of_block, "metadata"))), lambda x: x["metadata"])).alias("metadata")] if given else []),
        *map(latest, ("importance", "captured", "source_agent", "expires_at")), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.min("_entered").alias("_entered"),
        F.min("_first").alias("_first"), F.max("seq").alias("seq"), F.bool_or("_stored").alias("_stored"), F.min("_begun").alias("_begun"), F.min("_entry").alias("_entry"),
    )
    later = Window.partitionBy(*scope).orderBy("_version")
    merged = merged.withColumns({"importance": F.coalesce("importance", F.lit(0.5)), "id": F.coalesce("id", _row_id()), "deleted_at": F.when(F.col("canonical_key").isNotNull(), F.lead("_entered").over(later))})
    return rows, merged.withColumn("_previous", F.when(F.col("canonical_key").isNotNull(), F.lag("id").over(later)))


def filled(merged: DataFrame, live: DataFrame, ready: DataFrame) -> DataFrame:
    """merged, of versions(live, ready), with its contents, which move once."""
    texts = _texts(live, False).unionByName(_texts(ready, True)).groupBy("scope_type", "_scope", "content_hash").agg(F.min_by("content", "_order").alias("content"))
    return merged.join(texts, ["scope_type", "_scope", "content_hash"])


def _texts(df: DataFrame, new: bool) -> DataFrame:
    return df.select("scope_type", _scope(), "content_hash", "content", F.struct(F.lit(new), "seq").alias("_order"))


def dealt(merged: DataFrame, live: DataFrame, ready: DataFrame, by: dict[str, Column]) -> DataFrame:
    """As filled, in the tasks that by, columns made of scope_type, _scope and content_hash, deals rows out to; by is in the result. This is the only move of the contents, of which one write of each moves."""
    content = ["scope_type", "_scope", "content_hash"]
    seqs = ready.select("scope_type", _scope(), "content_hash", "seq")
    shared = seqs.groupBy(*content).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = kept(seqs.join(shared, content).where("seq > _first").select("seq"))
    texts = _texts(live, False).unionByName(_texts(few_out(ready, again, "seq"), True))
    rows = merged.select(*content, F.struct(*(c for c in merged.columns if c not in content)).alias("_row"))
    both = texts.unionByName(rows, allowMissingColumns=True).withColumns(by).repartition(*by)
    found = both.groupBy(*by, *content).agg(F.min_by("content", "_order").alias("content"), F.collect_list("_row").alias("_rows"))  # of tasks that are dealt out already
    return found.select(*by, *content, "content", F.explode("_rows").alias("_row")).select(*by, *content, "content", "_row.*")


def drop_replays(batch: DataFrame, store: DataFrame, keys: DataFrame) -> DataFrame:
    """batch without rows whose idempotency key already points to a live row of the same scope and content."""
    targets = latest_bindings(keys).join(store.where(F.col("deleted_at").isNull()).select(F.col("id").alias("memory_id"), F.col("scope_type").alias("_t"), F.col("scope_id").alias("_s"), F.col("content_hash").alias("_h")), "memory_id")
    ready = normalized(batch).select("seq", "idempotency_key", "scope_type", "scope_id", "content_hash")
    same = (F.col("idempotency_key") == F.col("key")) & (F.col("scope_type") == F.col("_t")) & F.col("scope_id").eqNullSafe(F.col("_s")) & (F.col("content_hash") == F.col("_h"))
    return batch.join(ready.join(targets, same, "left_semi").select("seq"), "seq", "left_anti")


def touched(store: DataFrame, ids: DataFrame, at: datetime) -> DataFrame:
    """store with last_accessed_at set for ids(id), the rows that a search returned: at most some hundreds."""
    known = F.col("last_accessed_at") if "last_accessed_at" in store.columns else F.lit(None).cast("timestamp")
    hit = store.join(F.broadcast(ids.select("id").distinct().withColumn("_hit", F.lit(True))), "id", "left")
    return hit.withColumn("last_accessed_at", F.when(F.col("_hit"), F.lit(at)).otherwise(known)).drop("_hit")


def capture(texts: DataFrame, max_facts: int = 5, tags: tuple[str, ...] = ("captured",)) -> DataFrame:
    """A batch for upsert from texts(seq, at, scope_type, scope_id, text): the best facts of each text."""
    best = facts.best(texts, ["seq"], limit=max_facts)
    return best.select(
        (F.col("seq") * 100 + F.col("rank")).alias("seq"), "at", F.lit(None).cast("string").alias("idempotency_key"), "scope_type", "scope_id", F.col("fact").alias("content"),
        F.array(*map(F.lit, tags)).alias("tags"), F.lit(0.6).alias("importance"), F.lit(None).cast("int").alias("ttl_days"), F.lit(None).cast("string").alias("key"),
        F.lit(True).alias("captured"), F.lit(None).cast("string").alias("source_agent"),
    )


def _deleted(store: DataFrame, hit, at: datetime) -> DataFrame:
    gone = F.col("deleted_at").isNull() & hit
    return store.withColumns({"deleted_at": F.when(gone, F.lit(at)).otherwise(F.col("deleted_at")), "updated_at": F.when(gone, F.lit(at)).otherwise(F.col("updated_at"))})


def delete(store: DataFrame, ids: list[str], at: datetime) -> DataFrame:
    """Soft-deletes rows by id."""
    return _deleted(store, F.col("id").isin(ids), at)


def forget(store: DataFrame, scope: Scope, at: datetime, before: datetime | None = None) -> DataFrame:
    """Soft-deletes a scope's rows, expired ones too, that were updated up to before."""
    hit = in_scope([scope])
    return _deleted(store, hit if before is None else hit & (F.col("updated_at") <= F.lit(before)), at)


def repaired(store: DataFrame) -> DataFrame:
    """Canonical keys filled in from contents, then all but the newest active row of a scope and key soft-deleted."""
    from tesserae.functions.text import resolved_key

    keyed = store.withColumn("canonical_key", F.coalesce("canonical_key", resolved_key(F.col("content"), F.col("tags"))))
    order = Window.partitionBy("scope_type", F.coalesce("scope_id", F.lit("")), "canonical_key", F.col("deleted_at").isNull(), F.when(F.col("canonical_key").isNull(), F.col("id"))).orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    extra = F.col("canonical_key").isNotNull() & F.col("deleted_at").isNull() & (F.row_number().over(order) > 1)
    return keyed.withColumn("_x", extra).withColumn("deleted_at", F.when(F.col("_x"), F.col("updated_at")).otherwise(F.col("deleted_at"))).drop("_x")


def repaired_bindings(keys: DataFrame, store: DataFrame) -> DataFrame:
    """keys(key, memory_id, ...) whose deleted targets have a canonical key point to the newest live row of that scope and key, if there is one."""
    scope = ["scope_type", F.coalesce("scope_id", F.lit("")).alias("_scope"), "canonical_key"]
    keyed = store.where(F.col("canonical_key").isNotNull())
    winner = keyed.where(F.col("deleted_at").isNull()).groupBy(*scope).agg(F.max_by("id", F.struct("updated_at", "created_at", "id")).alias("_winner"))
    stale = keyed.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("memory_id"), *scope)
    moved = stale.join(winner, ["scope_type", "_scope", "canonical_key"]).select("memory_id", "_winner")
    return keys.join(moved, "memory_id", "left").withColumn("memory_id", F.coalesce("_winner", "memory_id")).select(keys.columns)
