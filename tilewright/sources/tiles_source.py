"""Tile tables as Spark data sources: a synthetic reader, and Deep Zoom folders by name.

``spark.dataSource.register(SyntheticTiles)`` and then ``spark.read.format("synthetic_tiles")``
with options sizeX, sizeY, tile, frames.  A partition makes the tiles of some rows, so reading is
spread over executors whatever the image's size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class SyntheticTiles(DataSource):
    """frame, level, tx, ty, width, height and the tile's colour by position and frame."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_tiles"

    def schema(self) -> str:
        return "frame int, level int, tx int, ty int, width int, height int, r int, g int, b int"

    def reader(self, schema) -> DataSourceReader:
        return SyntheticReader(self.options)


class SyntheticReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.size_x, self.size_y = int(options.get("sizeX", 512)), int(options.get("sizeY", 512))
        self.tile, self.frames = int(options.get("tile", 256)), int(options.get("frames", 1))
        longest, self.levels = max(self.size_x, self.size_y), 1
        while self.tile << (self.levels - 1) < longest:
            self.levels += 1

    def partitions(self) -> list[InputPartition]:
        rows = -(-self.size_y // self.tile)
        step = max(1, -(-rows // 64))
        return [Rows(k, min(k + step, rows)) for k in range(0, rows, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for level in range(self.levels):
            scale = 1 << (self.levels - 1 - level)
            w, h = -(-self.size_x // scale), -(-self.size_y // scale)
            down, across = -(-h // self.tile), -(-w // self.tile)
            for ty in range(down):
                if not partition.first <= ty < partition.last:
                    continue
                for tx in range(across):
                    width, height = min(self.tile, w - tx * self.tile), min(self.tile, h - ty * self.tile)
                    for frame in range(self.frames):
                        yield frame, level, tx, ty, width, height, tx * 255 // max(across - 1, 1), ty * 255 // max(down - 1, 1), frame * 255 // max(self.frames - 1, 1)


#: Path of a Deep Zoom tile: .._files/level/x_y.ext
DEEP_ZOOM = r"([^/]+)_files/(\d+)/(\d+)_(\d+)\.(\w+)$"


def deep_zoom_parts(path: Column) -> dict[str, Column]:
    """Image, level, column, row and format in the path of a Deep Zoom tile."""
    part = lambda k: F.regexp_extract(path, DEEP_ZOOM, k)
    return {"image": part(1), "level": part(2).cast("int"), "tx": part(3).cast("int"), "ty": part(4).cast("int"), "format": part(5)}


def deep_zoom(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of all Deep Zoom images below a folder, with their encoded bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("path").rlike(DEEP_ZOOM)).select(*[c.alias(n) for n, c in deep_zoom_parts(F.col("path")).items()], F.col("content").alias("data"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """A tile table by level and frame: a reader of one level reads that level's files only."""
    tiles.repartition("level", "frame").write.partitionBy("level", "frame").mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
