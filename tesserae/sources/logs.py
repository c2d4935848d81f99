"""Session logs in JSON lines, two formats; transcripts; incremental listing.

Format A wraps messages as {timestamp, type: response_item, payload: {type, role, phase, content: [{type, text}], ...}};
format B as {timestamp, type: user|assistant, message: {role, content: text or [{type, text, ...}]}}.
Lines that are no JSON are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import trim

#: Messages that are instructions, not conversation.
BOILERPLATE_STARTS = ("# AGENTS.md instructions for", "<environment_context>", "<collaboration_mode>")
BOILERPLATE_PARTS = ("<permissions instructions>", "<app-context>")
PART = "type string, text string, name string, id string, tool_use_id string"
FORMAT_A = f"timestamp string, type string, payload struct<type:string, role:string, phase:string, content:array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>, name:string, namespace:string, call_id:string>"
FORMAT_B = "timestamp string, type string, message struct<role:string, content:string>"
PARTS = f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"
MAX_FILE_BYTES, MAX_MESSAGES = 1 << 20, 80
#: Places of a message's parts in the order of events.
PARTS_MOST = 1 << 20


def read(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(session, modified, pos, line) of the JSON-lines files below path; pos: the line's place in its file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    text = F.decode("content", "UTF-8")
    lines = files.select(F.col("path").alias("session"), F.col("modificationTime").alias("modified"), F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    return lines.where(trim(F.col("line")) != "")


def session_id(file: Column) -> Column:
    """The id of a session whose log names none: the file's base name, cut to 120 characters."""
    base = F.regexp_replace(F.substring_index(file, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.substring(F.concat(F.lit("import-"), base), 1, 120)


def newest_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, bytes) below path, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "file")


def unseen(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the state (file, modified, bytes) doesn't hold as they are now."""
    return files.join(state, ["file", "modified", "bytes"], "left_anti")


def _joined(parts: Column, kinds: tuple[str, ...]) -> Column:
    texts = F.transform(F.filter(parts, lambda p: p["type"].isin(*kinds)), lambda p: trim(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def conversation(text: Column) -> Column:
    """Not empty, and no boilerplate."""
    out = text != ""
    for s in BOILERPLATE_STARTS:
        out = out & ~text.startswith(s)
    for s in BOILERPLATE_PARTS:
        out = out & ~text.contains(s)
    return out


def messages_a(lines: DataFrame) -> DataFrame:
    """(session, pos, at, role, text) of format A."""
    p = F.from_json("line", FORMAT_A)
    rows = lines.withColumn("_p", p).where("_p.type = 'response_item' and _p.payload.type = 'message' and _p.payload.role in ('user', 'assistant')")
    rows = rows.where("not (_p.payload.role = 'assistant' and coalesce(_p.payload.phase, '') = 'commentary')")
    text = trim(F.coalesce(_joined(F.col("_p.payload.content"), ("input_text", "output_text")), F.lit("")))
    rows = rows.select("session", "pos", F.col("_p.timestamp").alias("at"), F.col("_p.payload.role").alias("role"), text.alias("text"))
    return rows.where(conversation(F.col("text")))


def messages_b(lines: DataFrame) -> DataFrame:
    """(session, pos, at, role, text) of format B, whose content is a text or a list of parts."""
    rows = lines.withColumn("_p", F.from_json("line", FORMAT_B)).where("_p.type in ('user', 'assistant') and coalesce(_p.message.role, _p.type) = _p.type")
    raw = F.col("_p.message.content")
    parts = F.from_json(raw, PARTS)
    listed = F.get_json_object("line", "$.message.content[0]").isNotNull() & raw.startswith("[")
    text = trim(F.coalesce(F.when(listed, _joined(parts, ("text", "input_text", "output_text"))).otherwise(raw), F.lit("")))
    rows = rows.select("session", "pos", F.col("_p.timestamp").alias("at"), F.col("_p.type").alias("role"), text.alias("text"))
    return rows.where(conversation(F.col("text")))


def tool_events_a(lines: DataFrame) -> DataFrame:
    """Events of tools for operators.tools.assistance: (session, pos, kind, name, call_id), of format A."""
    rows = lines.withColumn("_p", F.from_json("line", FORMAT_A)).where("_p.type = 'response_item'")
    kind = F.col("_p.payload.type")
    event = F.when(kind.isin("function_call", "custom_tool_call", "local_shell_call"), "call").when(kind == "function_call_output", "result")
    event = event.when(kind.isin("web_search_call", "web_fetch_call"), "web").when(kind == "tool_search_output", "search")
    name = F.coalesce(F.col("_p.payload.name"), F.when(kind != "function_call", kind))
    content = F.get_json_object("line", "$.payload.output")
    return rows.select("session", "pos", event.alias("kind"), name.alias("name"), F.col("_p.payload.call_id").alias("call_id"), content.alias("content")).where("kind is not null")


def tool_events_b(lines: DataFrame) -> DataFrame:
    """The same of format B, with n, the requests that a server counted: parts of a message, its usage, and results beside it."""
    rows = lines.withColumn("_c", F.get_json_object("line", "$.message.content")).where(F.get_json_object("line", "$").isNotNull())
    listed = F.from_json(F.when(F.col("_c").startswith("["), F.col("_c")), "array<string>")
    parts = rows.select("*", F.posexplode(listed).alias("_k", "_x"))
    g = lambda path: F.get_json_object("_x", path)
    kind = F.when(g("$.type") == "tool_use", "call").when(g("$.type") == "tool_result", "result")
    used = parts.select("session", (F.col("pos") * PARTS_MOST + F.col("_k")).alias("pos"), kind.alias("kind"), g("$.name").alias("name"), F.coalesce(g("$.id"), g("$.tool_use_id")).alias("call_id"), g("$.content").alias("content"), F.lit(None).cast("long").alias("n")).where("kind is not null")
    count = lambda what: F.coalesce(F.get_json_object("line", f"$.message.usage.server_tool_use.{what}_requests").cast("long"), F.lit(0))
    none = F.lit(None).cast("string")
    served = rows.select("session", (F.col("pos") * PARTS_MOST + PARTS_MOST - 2).alias("pos"), F.lit("uses").alias("kind"), none.alias("name"), none.alias("call_id"), none.alias("content"), (count("web_search") + count("web_fetch")).alias("n")).where("n > 0")
    beside = F.get_json_object("line", "$.toolUseResult")
    has_result = F.coalesce(F.exists(F.from_json(F.when(F.col("_c").startswith("["), F.col("_c")), "array<struct<type:string>>"), lambda p: p["type"] == "tool_result"), F.lit(False))
    lone = rows.where(beside.isNotNull() & ~has_result).select("session", (F.col("pos") * PARTS_MOST + PARTS_MOST - 1).alias("pos"), F.lit("result").alias("kind"), none.alias("name"), none.alias("call_id"), beside.alias("content"), F.lit(None).cast("long").alias("n"))
    return used.unionByName(served).unionByName(lone)


def tail(messages: DataFrame, n: int = MAX_MESSAGES) -> DataFrame:
    """The last n messages of each session."""
    order = Window.partitionBy("session").orderBy(F.desc("pos"))
    return messages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def transcripts(messages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(session, transcript, messages): lines "[at] Role: text" in order."""
    line = F.concat(F.lit("["), F.coalesce("at", F.lit("")), F.lit("] "), F.initcap("role"), F.lit(": "), F.col("text"))
    lines = messages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("session", F.array_join(F.transform("l", lambda x: x["line"]), separator).alias("transcript"), F.size("l").alias("messages"))
