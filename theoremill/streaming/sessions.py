"""Sessions that end after an idle time, over a stream or a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, begins, ends, events): sessions closed by ``idle`` time without an event.

    On a stream, state is kept until the watermark of ``late`` passes a session's end. Null keys form
    sessions of their own; rows with a null time are left out.
    """
    rows = events.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    grouped = rows.groupBy(key, F.session_window(at, idle).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "events")
