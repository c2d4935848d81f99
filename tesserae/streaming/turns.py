"""Streams: pairing a prompt with its answer by session, replay-safe ingest, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "session string, prompt string, answer string, at timestamp"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    prompt = state.get[0] if state.exists else None
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    out = []
    for kind, text, at in zip(rows["kind"], rows["text"], rows["at"]):
        text = (text or "").strip()
        if kind == "prompt":
            prompt = text
        elif kind == "stop":
            if prompt and text and not prompt.startswith("/"):
                out.append((key[0], prompt, text, at))
            prompt = None
    if prompt is None:
        if state.exists:
            state.remove()
    else:
        state.update((prompt,))
        state.setTimeoutDuration(86_400_000)
    yield pd.DataFrame(out, columns=["session", "prompt", "answer", "at"])


def turns(events: DataFrame) -> DataFrame:
    """Turns of a stream events(session, kind, text, at): a stop event closes the prompt before it.

    Slash commands and empty answers give no turn; a prompt waits a day at most.
    """
    return events.groupBy("session").applyInPandasWithState(_pair, TURN, "prompt string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def batch_turns(rows: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The same pairing over a table of role and text: a user's row and the assistant's row right after it."""
    by = Window.partitionBy(session).orderBy(order)
    nxt = rows.withColumn("_role", F.lead("role").over(by)).withColumn("answer", F.lead("text").over(by))
    kept = nxt.where((F.col("role") == "user") & (F.col("_role") == "assistant") & (F.trim("answer") != "") & ~F.trim("text").startswith("/"))
    return kept.select(session, order, F.col("text").alias("prompt"), "answer")


def first_of_key(stream: DataFrame, key: str = "idempotency_key", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """A stream without replays of a key within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def event_windows(events: DataFrame, at: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows; late events count until the watermark passes."""
    source = events.withWatermark(at, delay) if events.isStreaming else events
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return source.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", key: str = "user_id", delay: str = "2 hours") -> DataFrame:
    """Sessions of a key, closed by a gap without events."""
    source = events.withWatermark(at, delay) if events.isStreaming else events
    return source.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
