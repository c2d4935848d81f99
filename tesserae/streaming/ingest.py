"""Exactly-once ingest: each batch of a stream becomes one version of the store, which remembers the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesserae.sources.store import Store


def into_store(stream: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes all that stream (rows as for merge.write) has to the store, then ends.

    The number of the batch lies in the same manifest as its rows. A query that died after a version was made sends that batch
    again when it restarts from its checkpoint, and the store takes it for known.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: store.write(batch, name, number)).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
