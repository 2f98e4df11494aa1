"""Tile writes and pixel counts as streams (an extension: the batch operators, incrementally)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITES = "seq long, x long, y long, value double"


def writes(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files of pixel writes, read as they arrive."""
    return spark.readStream.schema(WRITES).parquet(path)


def last_writes(stream: DataFrame) -> DataFrame:
    """The value of the last write to each pixel so far: one row of state a pixel."""
    return stream.groupBy("x", "y").agg(F.max_by("value", "seq").alias("value"))


def running_histogram(stream: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts by bin of a fixed range: bounded state, however long the stream."""
    place = F.floor((F.col("value") - low) * bins / (high - low)).cast("long")
    return stream.where(F.col("value").between(low, high)).groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("count"))


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
