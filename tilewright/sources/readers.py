"""The reader catalogue: which reader opens a file, by extension and priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (reader, extension) -> priority; smaller first.  Readers of any file are fallbacks.
READERS = {
    "geo": {"tif": 3, "tiff": 3, "nitf": 1, "png": 5},
    "microscopy": {"svs": 1, "ndpi": 1, "tif": 4, "tiff": 4},
    "pyramid": {"tif": 1, "tiff": 1, "ptif": 1, "svs": 2},
    "composite": {"yml": 1, "yaml": 1, "json": 2},
    "chunks": {"zarr": 1, "zip": 3},
    "picture": {"png": 2, "jpg": 1, "jpeg": 1},
    "synthetic": {"synth": 1},
    "anything": {"": 9},
}


def rows() -> list[tuple[str, str, int, int]]:
    return [(r, e, p, int(r == "anything")) for r, x in sorted(READERS.items()) for e, p in sorted(x.items())]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "reader string, extension string, priority int, fallback int")


def ranking(spark: SparkSession) -> DataFrame:
    """Readers of each extension, best first."""
    w = Window.partitionBy("extension").orderBy("fallback", "priority", "reader")
    return table(spark).select("extension", "reader", F.row_number().over(w).cast("long").alias("place"))
