"""Idempotent ingestion of files: a file is read again only if its content changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash) of a binaryFile table."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def classify(current: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed, new or removed since ``known`` (path, hash)."""
    both = current.select("path", F.col("hash").alias("now")).join(known.select("path", F.col("hash").alias("then")), "path", "full_outer")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def work_left(current: DataFrame, known: DataFrame | None) -> DataFrame:
    """The paths to process: all without a checkpoint, else those new or changed."""
    return current.select("path") if known is None else classify(current, known).filter("status in ('new', 'changed')").select("path")


def merge_outputs(before: DataFrame, now: DataFrame, order: DataFrame) -> DataFrame:
    """Records of earlier runs for files that weren't read again, and the new ones, in the order of ``order``
    (path, place)."""
    kept = before.join(now.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(now).join(order, "path").orderBy("place").drop("place")


def deduplicated_append(stream: DataFrame, key: list[str], path: str, checkpoint: str, at: str, late: str = "1 hour") -> StreamingQuery:
    """Append a stream to a Parquet table, each key once within the watermark; offsets and state are in the
    checkpoint, so a restart neither loses nor repeats rows."""
    unique = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
    return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
