"""Import jobs: logs and exports become transcripts and facts of the store, by batches of the write path.

A job takes the store and gives back the new one, with a report of one row a session or conversation. Transcripts are memories of
their session; facts go to the capture scope, the project's by default, and stay there without expiry unless that is a session.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import lower_tags, trim
from tesserae.operators import ingest, merge, trees
from tesserae.plans.lineage import kept
from tesserae.plans.scope import Scope, active, in_scope, project_id
from tesserae.sources import logs

TRANSCRIPT_IMPORTANCE, MOST_FACTS, FIRST_ERRORS = 0.6, 20, 100
#: Days that transcripts of sessions and of exported conversations live.
SESSION_DAYS, CONVERSATION_DAYS = 30, 3650
MIN_PARENT_BYTES = 25_000
# What sources are called in texts, and the sentences around the name.
SESSIONS = {"codex-session": "Codex session", "claude-session": "Claude Code session"}
EXPORT, CONVERSATION, CONV_TAG = "chatgpt-export", "ChatGPT conversation", "chatgpt-conv:"
HINT = "Extract durable preferences, constraints, conventions, owners, deadlines, paths, and important facts from this imported {}."
FIRST_LINE = "Imported {} transcript from "
SKIP_REASON = "tool_assisted"


class Imported(NamedTuple):
    """store: the new store; report: what became of each source; keys: the bindings of idempotency keys after it."""

    store: DataFrame
    report: DataFrame
    keys: DataFrame


def _text_map(**values: Column) -> Column:
    """Metadata of strings, without those that are null."""
    pairs = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _capture_scope(kind: str, project_path: str | None, session: Column) -> tuple[Column, Column]:
    """Type and id of the scope that facts go to."""
    if kind == "project" and not project_path:
        raise ValueError("facts of a project need its path")
    ids = {"global": F.lit(None).cast("string"), "session": session, "project": F.lit(project_id(project_path) if project_path else None).cast("string")}
    return F.lit(kind), ids[kind]


def _transcript(number: Column, at: datetime, session: Column, content: Column, tags: Column, key: Column, days: int, agent: str, metadata: Column) -> list[Column]:
    """Columns of a transcript's write; number: the source's place, 100 writes apart."""
    no = lambda kind: F.lit(None).cast(kind)
    return [
        (number * 100).alias("seq"), F.lit(at).cast("timestamp").alias("at"), key.cast("string").alias("idempotency_key"), F.lit("session").alias("scope_type"), session.alias("scope_id"), content.alias("content"), tags.alias("tags"),
        F.lit(TRANSCRIPT_IMPORTANCE).alias("importance"), F.lit(days).alias("ttl_days"), no("string").alias("key"), F.lit(False).alias("captured"), F.lit(agent).alias("source_agent"), metadata.alias("metadata"),
    ]


def _facts(texts: DataFrame, max_facts: int, tags: Column) -> DataFrame:
    """A batch of the best facts of texts(number, at, scope_type, scope_id, text, _tags)."""
    rows = ingest.capture(texts.select(F.col("number").alias("seq"), "at", "scope_type", "scope_id", "text"), max(1, min(MOST_FACTS, max_facts)))
    named = texts.select(F.col("number").alias("_n"), tags.alias("_tags"))
    rows = rows.withColumn("_n", F.expr("seq div 100")).join(named, "_n").withColumn("tags", F.col("_tags")).drop("_n", "_tags")
    return rows.withColumn("metadata", F.create_map(F.lit("captured"), F.lit("true")))


def numbered(found: DataFrame) -> DataFrame:
    """found, computed once, with number: a place of its own for each row, whatever its key."""
    return kept(found.withColumn("number", F.monotonically_increasing_id()))


def _told(found: DataFrame, facts: DataFrame) -> DataFrame:
    """found(number, ...) and how many facts were created and known already."""
    per = facts.groupBy(F.expr("seq div 100").alias("number")).agg(F.count_if("created").alias("facts_created"), F.count_if(~F.col("created")).alias("facts_known"))
    return found.join(per, "number", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("facts_created", "facts_known")}).drop("number")


def import_sessions(
    store: DataFrame, messages: DataFrame, at: datetime, source: str, assisted: DataFrame | None = None, max_messages: int | None = logs.MAX_MESSAGES, max_facts: int = MOST_FACTS, skip_assisted: bool = True,
    project_path: str | None = None, capture_scope: str = "project", keys: DataFrame | None = None,
) -> Imported:
    """Transcripts of messages(session, pos, at, role, text), and the facts in them.

    Of each session the last max_messages count. Sessions that assisted(session, assisted) names keep their transcript, marked as
    tool-assisted, but give no facts, unless skip_assisted is off. report: session, messages, truncated, characters, capture_skipped,
    created, facts_created, facts_known.
    """
    total = messages.groupBy("session").agg(F.count(F.lit(1)).alias("_all"))
    found = logs.transcripts(messages if max_messages is None else logs.tail(messages, max_messages)).join(total, "session")
    if assisted is not None:
        found = found.join(assisted.select("session", "assisted"), "session", "left")
    skipped = F.coalesce(F.col("assisted"), F.lit(False)) & F.lit(skip_assisted) if assisted is not None else F.lit(False)
    found = numbered(found.withColumn("skipped", skipped))
    session, name = F.col("session"), SESSIONS.get(source, source)
    tags = F.concat(F.array(*map(F.lit, ("import", source, "transcript"))), F.when(F.col("skipped"), F.array(F.lit("tool-assisted"))).otherwise(F.array().cast("array<string>")))
    metadata = _text_map(source_agent=F.lit(f"{source}-import"), source_session_file=session, project_path=F.lit(project_path), capture_skipped=F.col("skipped"), capture_skip_reason=F.when(F.col("skipped"), SKIP_REASON))
    batch = found.select(*_transcript(F.col("number"), at, session, F.concat(F.lit(FIRST_LINE.format(name)), session, F.lit("\n\n"), F.col("transcript")), tags, F.lit(None), SESSION_DAYS, f"{source}-import", metadata))
    kind, scope = _capture_scope(capture_scope, project_path, session)
    texts = found.where("not skipped").select("number", F.lit(at).cast("timestamp").alias("at"), kind.alias("scope_type"), scope.alias("scope_id"), F.concat(F.lit(HINT.format(name) + "\n"), F.col("transcript")).alias("text"))
    facts = _facts(texts, max_facts, F.array(*map(F.lit, ("import", source, "captured"))))
    done = merge.write(store, batch.unionByName(facts), keys)
    whole = done.outcome.where("seq % 100 = 0").select(F.expr("seq div 100").alias("number"), "created")
    report = found.select("number", "session", "messages", (F.col("_all") - F.col("messages")).alias("truncated"), F.length("transcript").alias("characters"), F.col("skipped").alias("capture_skipped")).join(whole, "number")
    return Imported(done.store(store), _told(report, done.outcome.where("seq % 100 > 0")), done.keys)


def conversation_transcripts(conversations: DataFrame, nodes: DataFrame, now: datetime, strategy: str = "current") -> DataFrame:
    """(conv, transcript, messages) of conversations(conv, title, created, updated, current, model, archived, shard, file) over
    their trees nodes(conv, id, parent, role, time, text); strategy: current, longest or all.

    Messages of unknown time get the conversation's, and go by time, then by their place in the path. A head of seven lines names
    the conversation. Conversations without messages fall out.
    """
    if strategy == "all":
        path = trees.all_nodes(nodes)
    else:
        found = trees.longest_paths(nodes) if strategy == "longest" else trees.active_paths(conversations, nodes)
        path = found.select("conv", F.posexplode("path").alias("place", "id"))
    head = conversations.select("conv", *(F.col(c) if c in conversations.columns else F.lit(None).cast(k).alias(c) for c, k in (("title", "string"), ("created", "double"), ("updated", "double"), ("model", "string"), ("archived", "boolean"), ("shard", "string"), ("file", "string"))))
    rows = path.join(nodes, ["conv", "id"]).where("role in ('user', 'assistant') and text <> ''").join(head, "conv")
    time = F.coalesce("time", "updated", "created", F.lit(now).cast("timestamp").cast("double"))
    stamp = F.date_format(F.timestamp_millis((time * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.concat(F.lit("["), stamp, F.lit("] "), F.initcap("role"), F.lit(": "), F.col("text"))
    lines = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(time.alias("t"), "place", line.alias("line")))).alias("l"))
    named = lambda c, other: F.coalesce(F.nullif(trim(F.col(c)), F.lit("")), F.lit(other))
    text = F.concat_ws(
        "\n", F.lit("Imported ChatGPT conversation transcript"), F.concat(F.lit("Conversation ID: "), F.col("conv")), F.concat(F.lit("Title: "), named("title", "(untitled)")), F.concat(F.lit("Model: "), named("model", "unknown")),
        F.concat(F.lit("Archived: "), F.coalesce(F.col("archived"), F.lit(False)).cast("string")), F.concat(F.lit("Source shard: "), named("shard", "")), F.concat(F.lit("Source export zip: "), named("file", "")), F.lit(""), F.array_join(F.transform("l", lambda x: x["line"]), "\n"),
    )
    return lines.join(head, "conv").select("conv", text.alias("transcript"), F.size("l").alias("messages"))


def import_conversations(
    store: DataFrame, keys: DataFrame, conversations: DataFrame, nodes: DataFrame, at: datetime, strategy: str = "current", max_facts: int = MOST_FACTS, project_path: str | None = None, capture_scope: str = "project",
) -> Imported:
    """Transcripts of exported conversations (with key, their idempotency key) and the facts in them.

    Where a transcript is new, the session's other rows and the conversation's facts in the capture scope are soft-deleted, and its facts
    are captured; a transcript that the store has, by its key in keys(key, memory_id, seq) or its content, changes no facts. report: conv,
    messages, created, facts_created, facts_known.
    """
    found = numbered(conversation_transcripts(conversations, nodes, at, strategy).join(conversations.drop(*({"messages", "transcript"} & set(conversations.columns))), "conv"))
    tag = F.concat(F.lit(CONV_TAG), F.col("conv"))
    known = lambda c, kind="string": F.col(c) if c in conversations.columns else F.lit(None).cast(kind)
    metadata = _text_map(
        source_agent=F.lit(f"{EXPORT}-import"), source_conversation_id=F.col("conv"), source_update_time=F.coalesce(known("updated"), known("created"), F.lit("unknown")), source_export_zip=known("file"), source_shard=known("shard"),
        project_path=F.lit(project_path), conversation_title=known("title"), model_slug=known("model"), is_archived=known("archived"), branch_strategy=F.lit(strategy),
    )
    batch = found.select(*_transcript(F.col("number"), at, tag, F.col("transcript"), F.array(F.lit("import"), F.lit(EXPORT), F.lit("transcript"), tag), F.col("key"), CONVERSATION_DAYS, f"{EXPORT}-import", metadata))
    first = merge.write(store, batch, keys)
    made = first.outcome.where("created").select(F.expr("seq div 100").alias("number"), "id")
    fresh = kept(found.join(made, "number").withColumn("_tag", tag))
    kind, scope = _capture_scope(capture_scope, project_path, F.col("_tag"))
    texts = fresh.select("number", F.lit(at).cast("timestamp").alias("at"), kind.alias("scope_type"), scope.alias("scope_id"), F.concat(F.lit(HINT.format(CONVERSATION) + "\n"), F.col("transcript")).alias("text"), "_tag")
    facts = _facts(texts, max_facts, F.array(F.lit("import"), F.lit(EXPORT), F.lit("captured"), F.col("_tag")))
    cleared = superseded(first.store(store), fresh.select("_tag", "id"), capture_scope, project_path, at)
    second = merge.write(cleared, facts, first.keys)
    report = found.select("number", "conv", "messages").join(made.select("number", F.lit(True).alias("created")), "number", "left").withColumn("created", F.coalesce("created", F.lit(False)))
    return Imported(second.store(cleared), _told(report, second.outcome), second.keys)


def superseded(store: DataFrame, fresh: DataFrame, capture_scope: str, project_path: str | None, at: datetime) -> DataFrame:
    """store after new transcripts fresh(_tag, id): their sessions' other rows, and facts in the capture scope that carry a conversation's tag, are soft-deleted."""
    live = store.where(F.col("deleted_at").isNull())
    sessions = live.where("scope_type = 'session'").select("id", F.col("scope_id").alias("_tag")).join(fresh.withColumnRenamed("id", "_new"), "_tag").where("id <> _new").select("id")
    tags = F.col("tags")
    captured = live.where(F.array_contains(tags, EXPORT) & F.array_contains(tags, "captured"))
    if capture_scope == "session":
        captured = captured.where("scope_type = 'session'")
        tagged = captured.select("id", F.col("scope_id").alias("_tag"), F.explode("tags").alias("_t")).where("_t = _tag").select("id", "_tag")
    else:
        seen = Scope("global") if capture_scope == "global" else Scope("project", project_id(project_path or ""))
        tagged = captured.where(in_scope([seen])).select("id", F.explode("tags").alias("_tag"))
    gone = sessions.union(tagged.join(fresh.select("_tag"), "_tag", "left_semi").select("id")).distinct().withColumn("_gone", F.lit(True))
    hit = store.join(gone, "id", "left")
    return kept(hit.withColumns({c: F.when(F.col("_gone"), F.lit(at)).otherwise(F.col(c)) for c in ("deleted_at", "updated_at")}).select(store.columns))


def summary(reports: DataFrame, filtered: int = 0, errors: DataFrame | None = None) -> DataFrame:
    """One row of counters of import_conversations' report; errors(place, message): their number and the first ones, by place."""
    counted = reports.agg(F.count(F.lit(1)).alias("processed"), F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("skipped"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages")).withColumn("filtered", F.lit(filtered).cast("long"))
    if errors is None:
        return counted.withColumns({"n_errors": F.lit(0).cast("long"), "errors": F.array().cast("array<string>")})
    few = errors.orderBy("place", "message").limit(FIRST_ERRORS).agg(F.array_sort(F.collect_list(F.struct("place", "message"))).alias("_e")).select(F.col("_e.message").alias("errors"))
    return counted.crossJoin(F.broadcast(errors.agg(F.count(F.lit(1)).alias("n_errors")))).crossJoin(F.broadcast(few))  # one row each


def transcript_parents(store: DataFrame, now: datetime, min_bytes: int = MIN_PARENT_BYTES) -> DataFrame:
    """Active imported transcripts of over min_bytes, which are to be cut into chunks."""
    tags = lower_tags(F.col("tags"))
    return store.where(active(now) & F.array_contains(tags, "import") & F.array_contains(tags, "transcript") & (F.octet_length("content") > min_bytes))


def coverage(store: DataFrame, chunks: DataFrame, wanted: str, now: datetime, min_bytes: int = MIN_PARENT_BYTES) -> DataFrame:
    """One row: transcripts over min_bytes, and those among them whose chunks all have the wanted version and their content's hash."""
    parents = transcript_parents(store, now, min_bytes).select("id", "content_hash")
    whole = chunks.groupBy("parent_id").agg(F.min((F.col("version") == wanted).cast("int")).alias("v"), F.min("parent_hash").alias("a"), F.max("parent_hash").alias("b"))
    done = (F.col("v") == 1) & (F.col("a") == F.col("b")) & (F.col("a") == F.col("content_hash"))
    return parents.join(whole.withColumnRenamed("parent_id", "id"), "id", "left").agg(F.count(F.lit(1)).alias("oversized_rows"), F.count_if(done).alias("chunked_rows"))


def newest_of_project(lines: DataFrame, project_path: str, since: datetime | None = None) -> DataFrame:
    """(session, modified) of the newest file of lines(session, modified, pos, line) that mentions a project's path; since: changed then or up to a minute before."""
    rows = lines if since is None else lines.where(F.col("modified") >= F.lit(since - timedelta(seconds=60)))
    hit = rows.where(F.col("line").contains(project_path)).groupBy("session").agg(F.max("modified").alias("modified"))
    return hit.orderBy(F.desc("modified"), "session").limit(1)
