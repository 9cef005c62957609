"""Streaming extras: the batch operators' windows on unbounded event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(events: DataFrame, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Volumes of each job in fixed windows; later events than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("job_id", F.window("ts", every)).agg(F.sum("bytesRead").alias("bytesRead"), F.sum("bytesWritten").alias("bytesWritten"))


def open_phases(events: DataFrame, gap: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """I/O phases as sessions: runs of active events that are no further apart than a gap."""
    active = events.where((F.col("bytesRead") > 0) | (F.col("bytesWritten") > 0))
    return active.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap)).agg(F.sum("bytesRead").alias("read_volume"), F.sum("bytesWritten").alias("write_volume"))
