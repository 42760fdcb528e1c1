"""Streams into a collection: each micro-batch is one acknowledged write, flushes and maintenance follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def ingest(stream: DataFrame, target: Collection, checkpoint: str, flush_every: int = 1, upkeep: bool = False, interval: str | None = None) -> StreamingQuery:
    """Write a stream of (id, embedding[, deleted]) to a collection; without an interval, what is there now.

    A replayed micro-batch writes the same ids again, which changes nothing: the highest seq of an id decides.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        gone = batch.where("deleted").select("id") if "deleted" in batch.columns else None
        target.insert((batch.where(~F.coalesce("deleted", F.lit(False))) if gone is not None else batch).select("id", "embedding"))
        if gone is not None:
            target.delete(gone)
        batch.unpersist()
        if (number + 1) % flush_every == 0 and target.flush() and upkeep:
            target.maintain()

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()
