"""Streaming ingest: an extension, as memories come in batches anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import text as X


def fresh(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each content (kind and folded text) within the watermark; later copies inside it are dropped."""
    key = F.sha2(F.concat(F.coalesce("kind", F.lit("note")), F.lit("|"), X.fold(F.coalesce("content", F.lit("")))), 256)
    return stream.withColumn("content_key", key).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_key"])


def windowed(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts of a key by window of event time; a window is final when the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch through write(rows, number). A late fact needs no watermark: the timeline of its key is made anew from all its rows. A batch replayed after a failure is dropped by content hash."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
