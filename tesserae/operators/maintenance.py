"""Maintenance analytics: health, cleanup candidates, durability classes, drift, missing embeddings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import lower_tags, snippet
from tesserae.plans.scope import SCOPE_TYPES, active

EXPIRED_GRACE_DAYS, CAPTURED_GRACE_DAYS = 7, 45
RECENT_HOURS, AUDIT_LIMIT, SAMPLES, HISTORY = 48, 250, 5, 120
#: Why a row has its class.
REASONS = {
    "sensitive": "explicit sensitive tag", "currentness_sensitive": "explicit currentness-sensitive marker", "transcript_provenance": "transcript or import provenance marker",
    "durable_global_preference": "global canonical, preference, or synthesis row", "durable_project_memory": "project canonical, convention, recommendation, or synthesis row",
    "ephemeral_noise": "captured/import session residue without durable marker", "unclassified": "no durable or provenance marker matched",
}
#: Tags that make global and project rows durable.
GLOBAL_TAGS = ("canonical", "user-preference", "writing-preference", "preference", "style")
PROJECT_TAGS = ("repo-fact", "project-convention", "user-decision", "recommendation", "verification", "implemented", "automation", "installer", "architecture", "design")
SYNTHESIS_TAG = "chatgpt-export-synthesis"
DAY_GROWTH, WEEK_GROWTH, ACTIVE_JUMP, KEY_JUMP, STREAK, LARGE_BYTES = 0.05, 0.20, 500, 250, 3, 1 << 20


def health(memories: DataFrame, now: datetime) -> DataFrame:
    """One row of counts and sizes; 0 for an empty store."""
    live, alive = F.col("deleted_at").isNull(), active(now)
    embedded = live & F.col("embedding").isNotNull()
    bytes_of = F.octet_length(F.to_json("embedding")).cast("long")
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = memories.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(alive).alias("active"), F.count_if(~live).alias("soft_deleted"),
        F.count_if(live & (F.col("expires_at") < F.lit(now))).alias("expired_active"), F.count_if(embedded).alias("embedding_rows"),
        total(F.sum(F.when(embedded, bytes_of))).alias("embedding_bytes"), total(F.max(F.when(alive, F.octet_length("content")))).alias("max_content_bytes"),
    )
    mean = F.when(F.col("embedding_rows") > 0, F.round(F.col("embedding_bytes") / F.col("embedding_rows"))).otherwise(0)
    return rows.withColumn("avg_embedding_bytes", mean.cast("long"))


def scope_counts(memories: DataFrame, now: datetime) -> DataFrame:
    """Active rows of every scope type, 0 where there are none."""
    kinds = memories.sparkSession.createDataFrame([(k,) for k in SCOPE_TYPES], "scope_type string")
    found = memories.where(active(now)).groupBy("scope_type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(found, "scope_type", "left").select("scope_type", F.coalesce("n", F.lit(0)).alias("active"))


def chunk_health(chunks: DataFrame, memories: DataFrame, now: datetime) -> DataFrame:
    """Chunk rows, their bytes and distinct parents, of active parents."""
    parents = memories.where(active(now)).select(F.col("id").alias("parent_id"))
    joined = chunks.join(parents, "parent_id")
    return joined.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("chunk_bytes"), F.countDistinct("parent_id").alias("parents"))


def _unprotected() -> Column:
    tags = F.transform("tags", lambda t: F.lower(t))
    return F.col("canonical_key").isNull() & ~F.array_contains(tags, "canonical") & ~F.array_contains(tags, "user-preference")


def _expired(at: datetime, grace_days: int = EXPIRED_GRACE_DAYS) -> Column:
    return F.col("deleted_at").isNull() & F.coalesce(F.col("expires_at") <= F.lit(at - timedelta(days=grace_days)), F.lit(False)) & _unprotected()


def _captured(at: datetime, grace_days: int = CAPTURED_GRACE_DAYS) -> Column:
    tagged = F.array_contains(F.transform("tags", lambda t: F.lower(t)), "captured") | F.coalesce("captured", F.lit(False))
    return F.col("deleted_at").isNull() & (F.col("updated_at") <= F.lit(at - timedelta(days=grace_days))) & tagged & _unprotected() & ~_expired(at)


def expired_candidates(memories: DataFrame, at: datetime, grace_days: int = EXPIRED_GRACE_DAYS) -> DataFrame:
    return memories.where(_expired(at, grace_days))


def captured_candidates(memories: DataFrame, at: datetime, grace_days: int = CAPTURED_GRACE_DAYS) -> DataFrame:
    """Old captured rows that are not already candidates for their expiry."""
    return memories.where(_captured(at, grace_days))


def apply_cleanup(memories: DataFrame, at: datetime) -> DataFrame:
    """The store with all cleanup candidates soft-deleted."""
    hit = F.coalesce(_expired(at) | _captured(at), F.lit(False))
    return memories.withColumns({c: F.when(hit, F.lit(at)).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")})


def durability(rows: DataFrame) -> DataFrame:
    """rows with class: the first of seven rules that fits."""
    tags = lower_tags(F.col("tags"))
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    meta = lambda name: F.col(name).isNotNull() if name in rows.columns else F.lit(False)
    keyed = F.col("canonical_key").isNotNull() | has(SYNTHESIS_TAG)
    imported = F.lower(F.coalesce("source_agent", F.lit(""))).endswith("-import")
    return rows.withColumn(
        "class",
        F.when(has("sensitive"), "sensitive")
        .when(has("currentness-sensitive") | meta("currentness_note"), "currentness_sensitive")
        .when(has("transcript") | imported | meta("source_session_file") | meta("source_export_zip") | meta("source_conversation_id"), "transcript_provenance")
        .when((F.col("scope_type") == "global") & (keyed | has(*GLOBAL_TAGS)), "durable_global_preference")
        .when((F.col("scope_type") == "project") & (keyed | has(*PROJECT_TAGS)), "durable_project_memory")
        .when(has("captured", "import", "codex-session", "claude-session") | F.coalesce("captured", F.lit(False)), "ephemeral_noise")
        .otherwise("unclassified"),
    )


def audit_rows(memories: DataFrame, at: datetime, limit: int | None = AUDIT_LIMIT) -> DataFrame:
    """The newest rows of the last RECENT_HOURS and the newest synthesis rows, each once."""
    live = memories.where(F.col("deleted_at").isNull())
    recent = live.where(F.col("created_at") >= F.lit(at - timedelta(hours=RECENT_HOURS)))
    synthesis = live.where(F.array_contains(lower_tags(F.col("tags")), SYNTHESIS_TAG))
    order = [F.date_trunc("second", "created_at").desc(), F.desc("id")]
    if limit:
        recent, synthesis = recent.orderBy(*order).limit(limit), synthesis.orderBy(*order).limit(limit)
    return recent.unionByName(synthesis).dropDuplicates(["id"])


def audit(memories: DataFrame, at: datetime, limit: int | None = AUDIT_LIMIT, samples: int = SAMPLES) -> DataFrame:
    """Every durability class with its reason, its number of audited rows, whether it is left alone, and its newest samples.

    samples: array of struct(id, scope_type, scope_id, created_at, updated_at, tags, snippet), of samples rows at most.
    """
    rows = durability(audit_rows(memories, at, limit))
    newest = Window.partitionBy("class").orderBy(F.desc("created_at"), F.desc("id"))
    sample = F.struct(F.col("_r").alias("place"), "id", "scope_type", "scope_id", "created_at", "updated_at", "tags", snippet(F.col("content")).alias("snippet"))
    ranked = rows.withColumn("_r", F.row_number().over(newest))  # at most twice limit rows
    found = ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, sample))).alias("found"))
    kinds = memories.sparkSession.createDataFrame([(k, why, not k.startswith("durable")) for k, why in REASONS.items()], "class string, reason string, ignored boolean")
    whole = F.broadcast(kinds).join(found, "class", "left")
    return whole.select("class", "reason", "ignored", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("samples"))


def kept_history(snapshots: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest snapshots of a job's history, as many as are kept."""
    return snapshots.orderBy(F.desc("at")).limit(most)


def growth(current: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (current - baseline) / baseline).otherwise(F.when(current > 0, 1.0).otherwise(0.0))


def drift(snapshots: DataFrame, baseline_days: int = 6) -> DataFrame:
    """snapshots with changes against the one before and the latest one at least baseline_days older, the streak of snapshots
    with expired rows, and the alerts and notices that follow.

    snapshots(at, active, keys, bytes, expired_active); and where they are known, embeddings (ok or not), embedding_rows,
    max_content_bytes, oversized_rows and chunked_rows. They are few (a job's history), so their order is one window.
    """
    have = lambda c, kind: F.col(c) if c in snapshots.columns else F.lit(None).cast(kind)
    by_time = Window.orderBy("at")
    older = Window.orderBy(F.unix_seconds(F.col("at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -baseline_days * 86_400)
    rows = snapshots.withColumn("_n", F.row_number().over(by_time))
    last_zero = F.max(F.when(F.col("expired_active") <= 0, F.col("_n"))).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({
        "day_growth": growth(F.col("bytes"), F.lag("bytes").over(by_time)), "active_change": F.col("active") - F.lag("active").over(by_time),
        "key_change": F.col("keys") - F.lag("keys").over(by_time), "streak": F.col("_n") - F.coalesce(last_zero, F.lit(0)),
        "week_growth": growth(F.col("bytes"), F.last("bytes", True).over(older)),
        "_first": F.lag("bytes").over(by_time).isNull(), "_young": F.last("bytes", True).over(older).isNull(),
    })
    rows = rows.withColumns({"day_growth": F.when(~F.col("_first"), F.col("day_growth")), "week_growth": F.when(~F.col("_young"), F.col("week_growth"))})
    large = have("max_content_bytes", "long") > LARGE_BYTES
    covered = have("embedding_rows", "long") >= F.col("active")
    oversized, chunked = F.coalesce(have("oversized_rows", "long"), F.lit(0)), F.coalesce(have("chunked_rows", "long"), F.lit(0))
    alerts = [
        (have("embeddings", "string") != "ok", "embeddings_degraded"), (F.col("day_growth") > DAY_GROWTH, "db_growth_day"), (F.col("week_growth") > WEEK_GROWTH, "db_growth_week"),
        (F.col("active_change") > ACTIVE_JUMP, "active_growth_day"), (F.col("key_change") > KEY_JUMP, "idempotency_growth_day"), (F.col("streak") >= STREAK, "expired_active_streak"),
        (large & (~covered | (oversized > chunked)), "max_content_outlier"),
    ]
    whole = large & covered & (oversized <= chunked)
    notices = [(whole & (oversized > 0), "max_content_outlier_chunked"), (whole & (oversized == 0), "max_content_outlier_embedded")]
    listed = lambda rules: F.array_join(F.array_compact(F.array(*(F.when(when, F.lit(name)) for when, name in rules))), ",")
    return rows.withColumns({"alerts": listed(alerts), "notices": listed(notices)}).drop("_n", "_first", "_young")


def missing_embeddings(memories: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Rows that still need an embedding, expired ones too: id, content_chars."""
    rows = memories.where(F.col("deleted_at").isNull() & F.col("embedding").isNull())
    rows = rows if max_chars is None else rows.where(F.length("content") <= max_chars)
    return rows.select("id", F.length("content").cast("long").alias("content_chars"))


def in_order(rows: DataFrame, order: str, limit: int, size: Column | None = None) -> DataFrame:
    """The first rows for a maintenance job: oldest, newest, largest or smallest."""
    size = F.length("content") if size is None else size
    orders = {
        "oldest": ["created_at", "id"], "newest": [F.desc("created_at"), "id"], "largest": [size.desc(), "created_at", "id"], "smallest": [size.asc(), "created_at", "id"],
    }
    return rows.orderBy(*orders[order]).limit(limit)
