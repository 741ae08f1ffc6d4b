"""Streaming ingest of hits: an extra beyond the batch operators.

The gap rule of clustering as session windows with a watermark, and replace-by-event ingest by micro-batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import replace_groups
from ..tables import written


def hit_sessions(hits: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of hits of an event in a video without a gap, closed when the watermark passes; late hits are dropped."""
    w = F.session_window("ts", gap)
    out = hits.withWatermark("ts", late).groupBy(w.alias("w"), "video_id", "event_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    return out.select("video_id", "event_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hits", "best")


def ingest(hits: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("session_id", "event_id"), **trigger) -> StreamingQuery:
    """Each micro-batch replaces the groups of equal ``keys`` that it brings, as a snapshot (``sinks.live`` reads it).

    A row whose other columns are all null only names a group: alone it empties the group. A batch that is replayed after a
    failure is written once, as its number names it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = written(rows, "batch")
        others = [F.col(f"`{c}`").isNotNull() for c in rows.columns if c not in keys]
        replace_groups(rows.where(reduce(lambda a, b: a | b, others)) if others else rows, rows, path, keys, f"stream-{number}")

    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
