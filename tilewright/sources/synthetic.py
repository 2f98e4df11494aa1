"""A synthetic raster that needs no codec: nested squares, and frames on any axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def squares(spark: SparkSession, size: int, depth: int) -> DataFrame:
    """x, y, filled: in every cell of size, size / 2, .. the middle half is filled."""
    filled = F.lit(False)
    for k in range(depth):
        cell = size >> k
        middle = [(F.col(c) % cell).between(cell // 4, 3 * cell // 4 - 1) for c in ("x", "y")]
        filled = filled | (middle[0] & middle[1])
    return spark.range(size * size).select((F.col("id") % size).alias("x"), F.expr(f"id div {size}").alias("y")).withColumn("filled", filled)
