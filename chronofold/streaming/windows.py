"""Event-time windows over a stream of transients; the same aggregation serves batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and largest value by window and kind; a watermark bounds the state of a stream."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return g.select(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("start"), "event_type", "n", "top")


def sessions(events: DataFrame, gap: str = "100 seconds", late: str = "10 minutes") -> DataFrame:
    """Rows of a kind at most `gap` apart: first and last time (microseconds) and count."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    g = d.groupBy(F.session_window("ts", gap).alias("w"), "event_type").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n"))
    return g.select("event_type", "start_us", "end_us", "n")


def first_by_key(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of their key; on a stream, state is kept as long as rows can be late."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ts").alias("r")).select(*keys, "r.*")


def append_misses(rows: DataFrame, path: str, checkpoint: str):
    """Stream writer that adds rows whose key the window store lacks, one transaction for each batch."""
    from chronofold.sources import store

    return rows.writeStream.foreachBatch(lambda batch, _: store.append(batch.sparkSession, path, batch)).option("checkpointLocation", checkpoint)
