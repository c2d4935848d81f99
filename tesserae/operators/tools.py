"""Tool assistance of a session: which calls of tools, and results of them, a log shows besides the memory's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The memory's own tools, web tools and tool search.
MEMORY_TOOLS = ("memory_get_context", "memory_capture", "memory_upsert", "memory_delete", "memory_health", "memory_forget_scope", "memory_search_compact", "memory_search")
WEB_TOOLS = ("websearch", "webfetch", "web_search", "web_fetch", "web.run", "search_query", "image_query")
SEARCH_TOOLS = ("toolsearch", "tool_search", "tool_search_tool")
NO_NAME = "(unknown tool)"
WEB_PATTERN = r"(^|[_-])web[_-]?(search|fetch)($|[_-])"


def tool_name(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Lower case, trimmed, without one of the prefixes of a tool server."""
    out = F.lower(F.trim(name))
    for p in prefixes:
        out = F.when(out.startswith(p), F.substring(out, len(p) + 1, 10_000)).otherwise(out)
    return out


def is_memory_tool(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    return F.coalesce(tool_name(name, prefixes).isin(*MEMORY_TOOLS), F.lit(False))


def is_web_tool(name: Column) -> Column:
    n = tool_name(name)
    return F.coalesce(n.isin(*WEB_TOOLS) | n.rlike(WEB_PATTERN), F.lit(False))


#: Fixed value: texts of results that show a search of the web.
WEB_TEXT = r"(?i)\b(web search|websearch|web fetch|webfetch)\b"


def assistance(events: DataFrame, prefixes: tuple[str, ...] = (), unknown_results: bool = True) -> DataFrame:
    """One row a session of events(session, pos, kind, name, call_id); kind: call, result, web, search, or uses.

    A result belongs to the calls of its call_id before it in the log; results of the memory's own calls are counted apart.
    Results without a known call count too, as in logs of format B; with unknown_results=False, as in format A, only
    if their content, an optional column, mentions the web. uses: n requests to the web that a server counted, n being an
    optional column too.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    rows = events.select("session", "pos", "kind", "name", "call_id", have("content", "string").alias("content"), have("n", "long").alias("n"))
    rows = rows.withColumn("own", F.when(F.col("kind") == "call", is_memory_tool(F.col("name"), prefixes)))
    before = Window.partitionBy("session", "call_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.where(F.col("call_id").isNotNull() & F.col("kind").isin("call", "result"))
    named = named.withColumns({"_own": F.coalesce(F.max("own").over(before), F.lit(False)), "_name": F.last(F.when(~F.col("own"), F.coalesce("name", F.lit(NO_NAME))), True).over(before)})
    others = rows.where(F.col("call_id").isNull() | ~F.col("kind").isin("call", "result")).withColumns({"_own": F.lit(False), "_name": F.lit(None).cast("string")})
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    mentions = F.coalesce(F.col("content").rlike(WEB_TEXT), F.lit(False))
    what = F.when(is_call, F.when(F.col("own"), "own_call").otherwise("call")).when(is_result, F.when(F.col("_own"), "own_result").otherwise("result")).otherwise(F.col("kind"))
    facts = named.unionByName(others).withColumn("what", what).where(~is_result | F.lit(unknown_results) | F.col("_own") | F.col("_name").isNotNull() | mentions)
    name = F.when(is_call, F.coalesce("name", F.lit(NO_NAME))).when(is_result, F.col("_name")).when(F.col("kind") == "uses", F.lit("server_web_tool")).otherwise(F.coalesce("name", "kind"))
    facts = facts.withColumn("name", name)
    is_web = is_web_tool(F.col("name"))
    hits = F.when(F.col("what").isin("call") & is_web, 1).when((F.col("what") == "result") & (is_web | mentions), 1).when(F.col("what") == "web", 1).when(F.col("what") == "uses", F.coalesce("n", F.lit(0))).otherwise(0)
    search = (F.col("what") == "search") | ((F.col("what") == "call") & F.coalesce(tool_name(F.col("name")).isin(*SEARCH_TOOLS), F.lit(False)))
    facts = facts.withColumns({"_web": hits.cast("long"), "_search": search})
    outside = F.col("what").isin("call", "result", "web", "search") | ((F.col("what") == "uses") & (F.col("_web") > 0))
    reason = F.array_compact(F.array(F.when(F.col("what") == "call", "tool_call"), F.when(F.col("what") == "result", "tool_result"), F.when(F.col("_web") > 0, "web_call"), F.when(F.col("_search"), "tool_search")))
    count = lambda what: F.count_if(F.col("what") == what)
    return facts.withColumn("_reason", reason).groupBy("session").agg(
        count("call").alias("tool_calls"), count("result").alias("tool_results"), F.sum("_web").alias("web_calls"), F.count_if("_search").alias("search_calls"),
        count("own_call").alias("own_calls"), count("own_result").alias("own_results"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_reason")))).alias("reasons"), F.array_sort(F.collect_set(F.when(outside, F.col("name")))).alias("names"),
    ).withColumn("assisted", F.size("reasons") > 0)
