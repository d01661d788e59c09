"""A folder of packages as a stream. An addition: each new archive is checked once, with a checkpoint that survives restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_packages(spark: SparkSession, path: str) -> DataFrame:
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").load(path)
    return stream.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("epub"), "content", F.col("modificationTime").alias("at"))


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles all that is there and stops; the next call goes on after it."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type in windows of an hour; later events than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
