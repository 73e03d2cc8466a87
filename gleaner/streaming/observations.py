"""Observations as a stream: an extra of this engine. Each micro-batch is one snapshot upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import upsert


def maintain(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], seq: str, checkpoint: str, **upsert_options) -> StreamingQuery:
    """Keep a snapshot current: the last observation of a key in a batch wins. ``write`` gets the batch's number, so that a
    replayed batch overwrites its own result."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = upsert.last_written(batch, keys, seq)
        write(upsert.upsert(read(), rows.drop(seq), keys, **upsert_options), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Observations for each type in event-time windows; those later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen_at")).select(F.col("w.start").alias("start"), "event_type", "n", "last_seen_at")
