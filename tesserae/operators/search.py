"""Hybrid retrieval: lexical and vector candidates, fused scores, noise demotion, two-tier order, budgets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import scoring as S
from tesserae.functions.text import is_preference_query, is_temporal_query, preference_terms, token_estimate, trim, truncated
from tesserae.operators import canonical, lexical
from tesserae.plans.scope import Scope, active, in_scope, visible

#: Vectors that a query looks at and keeps, of rows and of chunks.
ROW_POOL, ROW_KEPT, CHUNK_POOL, CHUNK_KEPT = 1000, 100, 5000, 200
MAX_LIMIT = 200
#: Least, default and most characters of a content and bytes of a response; both for small clients; and a context's items and tokens.
CONTENT_CHARS, RESPONSE_BYTES, COMPACT = (120, 1200, 50_000), (1000, 220_000, 900_000), (700, 180_000)
CONTEXT_ITEMS, CONTEXT_TOKENS = 12, 1200


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def semantic_candidates(rows: DataFrame, query: list[float], pool: int = ROW_POOL, kept: int = ROW_KEPT) -> DataFrame:
    """(id, semantic) of the nearest among the pool newest rows with an embedding."""
    newest = rows.where(F.col("embedding").isNotNull()).select("id", "embedding", "updated_at").orderBy(F.desc("updated_at"), "id").limit(pool)
    near = newest.select("id", S.cosine(F.col("embedding"), vector_literal(query)).alias("semantic"))
    return near.orderBy(F.round("semantic", 9).desc(), "id").limit(kept)


def chunk_candidates(chunks: DataFrame, parents: DataFrame, query: list[float], pool: int | None = CHUNK_POOL, kept: int | None = CHUNK_KEPT) -> DataFrame:
    """(id, semantic, chunk) of chunks(parent_id, chunk_index, content, embedding) whose parent is among parents(id, updated_at).

    Of the pool chunks of the newest parents the kept nearest count; None stands for all.
    """
    joined = chunks.join(parents.select(F.col("id").alias("parent_id"), F.col("updated_at").alias("_at")), "parent_id")
    newest = joined.where(F.col("embedding").isNotNull())
    newest = newest if pool is None else newest.orderBy(F.desc("_at"), "parent_id", "chunk_index").limit(pool)
    near = newest.withColumn("semantic", S.cosine(F.col("embedding"), vector_literal(query)))
    near = near if kept is None else near.orderBy(F.round("semantic", 9).desc(), "parent_id", "chunk_index").limit(kept)
    chunk = F.struct("chunk_index", "content")
    best = F.max_by(F.struct("semantic", chunk.alias("chunk")), F.struct(F.round("semantic", 9), -F.col("chunk_index")))
    return near.groupBy(F.col("parent_id").alias("id")).agg(best.alias("b")).select("id", "b.semantic", "b.chunk")


def fold_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, semantic, chunk): the better of a row's own vector and its best chunk; the row wins ties."""
    a, b = rows.select("id", F.col("semantic").alias("_own")), chunks
    both = a.join(b, "id", "full_outer")
    by_chunk = F.col("semantic").isNotNull() & (F.col("_own").isNull() | (F.col("semantic") > F.col("_own")))
    return both.select("id", F.when(by_chunk, F.col("semantic")).otherwise(F.col("_own")).alias("semantic"), F.when(by_chunk, F.col("chunk")).alias("chunk"))


def ranked(candidates: DataFrame, now: datetime, embeddings: bool, min_score: float = 0.0) -> DataFrame:
    """Scores and order of candidates with bm25 and semantic: score, noisy, backfill, rank (1 is best)."""
    lexical_score, semantic = S.lexical(F.col("bm25")), F.coalesce(F.col("semantic"), F.lit(0.0))
    base = S.combined(semantic, lexical_score, S.importance(F.col("importance")), S.recency(F.col("updated_at"), now), F.col("scope_type"), embeddings)
    noisy = S.noisy(F.col("scope_type"), F.col("tags"), F.col("captured"), F.col("canonical_key"))
    rows = candidates.withColumn("_noisy", noisy).withColumn("_lexical", lexical_score)
    rows = rows.withColumn("score", S.unit(base - S.penalty(F.col("_noisy"), F.col("_lexical"))))
    rows = rows.withColumn("backfill", F.col("_noisy") & (F.col("_lexical") <= 0)).where(F.col("score") >= max(0.0, min(1.0, min_score)))
    order = Window.orderBy("backfill", F.round("score", 9).desc(), F.desc("updated_at"), "id")  # candidates are bounded
    return rows.withColumn("rank", F.row_number().over(order)).withColumnRenamed("_noisy", "noisy").drop("_lexical")


def search(memories: DataFrame, query: str, scopes: list[Scope], now: datetime, vector: list[float] | None = None, chunks: DataFrame | None = None, limit: int = 20, min_score: float = 0.0, found: DataFrame | None = None) -> DataFrame:
    """The best rows for a query, with score, rank and total (matches before the limit).

    Without any candidate the newest rows come back with score 0. found: lexical candidates (id, bm25) that are known already.
    """
    limit = max(1, min(MAX_LIMIT, limit))
    seen = in_scope(scopes) & active(now)
    pool = memories.where(seen)
    found = lexical.candidates(memories.where(F.col("deleted_at").isNull()), query, where=seen) if found is None else found
    if vector is not None:
        near = semantic_candidates(pool, vector)
        if chunks is not None:
            near = fold_chunks(near, chunk_candidates(chunks, pool, vector))
        found = found.join(near, "id", "full_outer")
    else:
        found = found.withColumn("semantic", F.lit(None).cast("double"))
    # some hundred candidates at most; with them in hand the store is filtered by a broadcast and never shuffled
    hits = found.collect()
    columns = [*memories.columns, "score", "rank", "total"]
    total = F.count(F.lit(1)).over(Window.partitionBy())
    if not hits:
        newest = pool.orderBy(F.desc("updated_at"), "id").limit(min(100, 2 * limit)).withColumn("score", F.lit(0.0))
        newest = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id"))).withColumn("total", total)
        return newest.where(F.col("rank") <= limit).select(columns)
    rows = pool.join(F.broadcast(memories.sparkSession.createDataFrame(hits, found.schema)), "id")
    if chunks is not None and vector is not None:
        rows = rows.withColumn("content", F.coalesce("chunk.content", "content"))
    best = ranked(rows, now, vector is not None, min_score).withColumn("total", total)
    return best.where(F.col("rank") <= limit).select(columns)


def shown_item(rows: DataFrame, content: Column) -> Column:
    """What a response tells of a row, with the given content."""
    names = ("tags", "importance", "created_at", "updated_at", "expires_at")
    extra = [F.col(c) for c in names if c in rows.columns]
    scope = [F.struct(F.col("scope_type").alias("type"), F.col("scope_id").alias("id")).alias("scope")] if "scope_type" in rows.columns else []
    return F.struct(F.col("id"), *scope, content.alias("content"), *extra)


def _folded(ranked: DataFrame, item: Column, start: Column, step) -> DataFrame:
    """(id, place, used, content) of the greedy choice in rank order; step(acc, item): acc struct(used, ids, contents). At most MAX_LIMIT rows count."""
    items = ranked.where(F.col("rank") <= MAX_LIMIT).agg(F.array_sort(F.collect_list(F.struct("rank", "id", item.alias("i")))).alias("items"), start.cast("long").alias("start"))
    none = F.array().cast("array<string>")
    zero = F.struct(F.col("start").alias("used"), none.alias("ids"), none.alias("contents"))
    chosen = items.select(F.aggregate("items", zero, step).alias("a")).select("a.used", F.posexplode(F.arrays_zip("a.ids", "a.contents")).alias("place", "x"))
    return chosen.select(F.col("x.ids").alias("id"), (F.col("place") + 1).alias("place"), "used", F.col("x.contents").alias("content"))


def _with(acc: Column, x: Column, cost: Column, content: Column) -> Column:
    return F.struct((acc["used"] + cost).alias("used"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"), F.concat(acc["contents"], F.array(content)).alias("contents"))


def pack_tokens(ranked: DataFrame, budget: int = CONTEXT_TOKENS, max_items: int = CONTEXT_ITEMS, content: str = "content") -> DataFrame:
    """(id, place, used, content): items for a token budget; the first is always taken, one that doesn't fit is skipped."""
    item = F.struct(token_estimate(F.col(content)).alias("cost"), F.col(content).alias("content"))

    def step(acc: Column, x: Column) -> Column:
        n, cost = F.size(acc["ids"]), x["i"]["cost"]
        return F.when((n < max_items) & ((n == 0) | (acc["used"] + cost <= budget)), _with(acc, x, cost, x["i"]["content"])).otherwise(acc)

    return _folded(ranked, item, F.lit(0), step)


def pack_bytes(ranked: DataFrame, budget: int = RESPONSE_BYTES[1], max_chars: int = CONTENT_CHARS[1], content: str = "content") -> DataFrame:
    """(id, place, used, content): items whose JSON fits a byte budget, contents cut to max_chars first.

    One that doesn't fit is skipped; but while nothing has been taken, it is tried once more with a quarter of the content. used begins
    with the bytes of the empty response and its total.
    """
    short = max(CONTENT_CHARS[0], max_chars // 4)

    def shaped(limit: int) -> Column:
        text = truncated(F.col(content), limit)
        return F.struct(F.octet_length(F.to_json(shown_item(ranked, text))).cast("long").alias("cost"), text.alias("content"))

    def step(acc: Column, x: Column) -> Column:
        a, b = x["i"]["whole"], x["i"]["short"]
        return F.when(acc["used"] + a["cost"] <= budget, _with(acc, x, a["cost"], a["content"])).when((F.size(acc["ids"]) == 0) & (acc["used"] + b["cost"] <= budget), _with(acc, x, b["cost"], b["content"])).otherwise(acc)

    total = F.max("total") if "total" in ranked.columns else F.count(F.lit(1))
    start = F.length(F.concat(F.lit('{"items":[],"total":}'), F.coalesce(total, F.lit(0)).cast("string")))
    return _folded(ranked, F.struct(shaped(max_chars).alias("whole"), shaped(short).alias("short")), start, step)


def clamped(value: int | None, least: int, default: int, most: int) -> int:
    return default if value is None else max(least, min(most, int(value)))


def response(memories: DataFrame, query: str, scopes: list[Scope], now: datetime, vector: list[float] | None = None, chunks: DataFrame | None = None, limit: int = 20, min_score: float = 0.0, max_chars: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(id, place, used, content, total): a search's rows shaped for a response of bounded size."""
    found = search(memories, query, scopes, now, vector, chunks, limit, min_score)
    packed = pack_bytes(found, clamped(max_bytes, *RESPONSE_BYTES), clamped(max_chars, *CONTENT_CHARS))
    return packed.crossJoin(F.broadcast(found.agg(F.max("total").alias("total"))))  # one row


def compact_response(memories: DataFrame, query: str, scopes: list[Scope], now: datetime, vector: list[float] | None = None, chunks: DataFrame | None = None, limit: int = 12, min_score: float = 0.0) -> DataFrame:
    """response, for clients that take small ones only."""
    return response(memories, query, scopes, now, vector, chunks, max(1, min(50, limit)), min_score, *COMPACT)


@dataclass(frozen=True)
class Context:
    """What a prompt gets: items(id, place, scope_type, score, used, content), summary(summary), scopes(scope_type) in order of use, and the timeline of the items' keys for questions about the past."""

    items: DataFrame
    summary: DataFrame
    scopes: DataFrame
    timeline: DataFrame | None


def context(memories: DataFrame, query: str, now: datetime, project_path: str | None = None, session_id: str | None = None, scopes: list[Scope] | None = None, vector: list[float] | None = None, chunks: DataFrame | None = None, max_items: int | None = None, token_budget: int | None = None) -> Context:
    """The best rows for a prompt within a token budget; a question about preferences gets the winners of their keys instead."""
    seen = visible(scopes, project_path, session_id)
    rows = memories.where(in_scope(seen))
    found = search(memories, query, seen, now, vector, chunks, MAX_LIMIT)
    if is_preference_query(query):
        best = canonical.preferred(rows, preference_terms(query), now, found).withColumn("score", F.col("effective"))
    else:
        best = found
    picked = pack_tokens(best, clamped(token_budget, 200, CONTEXT_TOKENS, 10_000), clamped(max_items, 1, CONTEXT_ITEMS, 50))
    known = best.select("id", "scope_type", "score", "canonical_key")  # at most MAX_LIMIT rows
    items = picked.join(F.broadcast(known), "id").select("id", "place", "scope_type", "score", "canonical_key", "used", "content")
    used = items.groupBy("scope_type").agg(F.min("place").alias("place")).orderBy("place")
    past = None
    if is_temporal_query(query):
        keys = items.where(F.col("canonical_key").isNotNull()).select("canonical_key").distinct()
        past = canonical.timeline(rows.join(F.broadcast(keys), "canonical_key", "left_semi"), None, now)
    return Context(items, summary(items.withColumn("rank", F.col("place"))), used, past)


def prompt(found: Context) -> DataFrame:
    """One row: the context as text for a prompt."""
    line = F.concat(F.col("place").cast("string"), F.lit(". ["), F.col("scope_type"), F.lit("] "), F.col("content"))
    items = found.items.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))  # at most 50
    listed = F.when(F.size("l") == 0, F.lit("(none)")).otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    both = found.summary.crossJoin(F.broadcast(items))  # one row each
    return both.select(F.concat(F.lit("[Memory Context Summary]\n"), F.col("summary"), F.lit("\n\n[Retrieved Memory Items]\n"), listed).alias("prompt"))


def summary(ranked: DataFrame, items: int = 8, width: int = 140, content: str = "content") -> DataFrame:
    """One row: numbered one-line summaries of the first items."""
    flat = trim(F.regexp_replace(content, r"(?U)\s+", " "))
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.col("scope_type"), F.lit("] "), F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 3), F.lit("..."))))
    lines = ranked.where(F.col("rank") <= items).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select(F.when(F.size("l") == 0, "No relevant memory found.").otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("summary"))
