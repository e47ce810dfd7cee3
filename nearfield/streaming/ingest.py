"""Continuous ingestion: each micro-batch becomes a delta segment, once, whatever is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.storage import IndexStore


def ingest(stream: DataFrame, store: IndexStore, checkpoint: str, name: str = "ingest", compact_every: int | None = None, **trigger) -> StreamingQuery:
    """Append a stream of [id, vec] to a trained index.

    The manifest that commits a segment also records its batch, so a batch that Spark
    replays after a failure is skipped. ``compact_every`` segments are merged into one.
    """
    store.index._trained()

    def append(batch: DataFrame, number: int) -> None:
        store.add(batch, (name, number))
        if compact_every and len(store.manifest["segments"]) > compact_every:
            store.compact()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
