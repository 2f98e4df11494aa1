"""An opened raster: its pixels as a table, with the tile, region and statistics calls on it.

    r = Raster(pixels, width=200, height=160, tile=64, magnification=20, mm=0.0005)
    r.tiles(overlap=16), r.region(10, 10, 50, 40, 25, 20), r.histogram(32), r.pyramid("mean")

Nothing runs until a result is read; every call returns a DataFrame or a number of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import raster as R
from tilewright.operators import tiling as T
from tilewright.sources import tiles_source


@dataclass
class Raster:
    """``pixels``: x, y, value, and band and frame if there are several."""

    pixels: DataFrame
    width: int
    height: int
    tile: int = 256
    magnification: float | None = None
    mm: float | None = None
    by: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.by = self.by or [c for c in ("frame", "band") if c in self.pixels.columns]

    @property
    def levels(self) -> int:
        """Levels from one tile for all to full resolution."""
        return 1 + max(0, math.ceil(math.log2(max(self.width, self.height) / self.tile)))

    def metadata(self) -> dict:
        return {"sizeX": self.width, "sizeY": self.height, "tileWidth": self.tile, "tileHeight": self.tile, "levels": self.levels, "magnification": self.magnification, "mm_x": self.mm, "mm_y": self.mm}

    def at_level(self, level: int) -> dict:
        """Scale, magnification and millimetres of a pixel of a level."""
        s = 2.0 ** (self.levels - 1 - level)
        return {"level": level, "scale": s, "magnification": self.magnification and self.magnification / s, "mm_x": self.mm and self.mm * s, "mm_y": self.mm and self.mm * s}

    def axes(self, tile: int | None = None, overlap: int = 0, region: tuple[int, int, int, int] | None = None, edges: bool = False) -> tuple[T.Axis, T.Axis]:
        left, top, right, bottom = region or (0, 0, self.width, self.height)
        tile = tile or self.tile
        return T.Axis(self.width, tile, overlap, left, right, edges), T.Axis(self.height, tile, overlap, top, bottom, edges)

    def tiles(self, tile: int | None = None, overlap: int = 0, region: tuple[int, int, int, int] | None = None, edges: bool = False) -> DataFrame:
        """The tile records of a grid over the image or a region (left, top, right, bottom)."""
        return T.tile_grid(self.pixels.sparkSession, *self.axes(tile, overlap, region, edges))

    def tile_count(self, **grid) -> int:
        x, y = self.axes(**grid)
        return x.count * y.count

    def single_tile(self, position: int = 0, **grid) -> DataFrame:
        return self.tiles(**grid).where(F.col("position") == position)

    def tile_pixels(self, keep_overlap: bool = True, **grid) -> DataFrame:
        """Pixels with the position of each tile that holds them."""
        return T.pixels_in_tiles(self.pixels, *self.axes(**grid), keep_overlap)

    def region(self, left: int, top: int, width: int, height: int, out_w: int | None = None, out_h: int | None = None) -> DataFrame:
        """A region, by nearest pixel if another size is asked for."""
        return R.region_nearest(self.pixels, left, top, width, height, out_w or width, out_h or height)

    def thumbnail(self, width: int = 256, height: int = 256) -> DataFrame:
        scale = min(width / self.width, height / self.height)
        return self.region(0, 0, self.width, self.height, max(2, int(self.width * scale)), max(2, int(self.height * scale)))

    def pixel(self, x: int, y: int) -> DataFrame:
        return self.pixels.where((F.col("x") == x) & (F.col("y") == y)).select(*self.by, "value")

    def band_information(self) -> DataFrame:
        return R.band_stats(self.pixels, self.by)

    def histogram(self, bins: int = 256, **options) -> DataFrame:
        return R.histogram(self.pixels, bins, self.by, **options)

    def pyramid(self, method: str = "mean") -> DataFrame:
        """All levels in one table with a column ``level``; each level from the one above it."""
        level, out, w, h = self.pixels.select(*self.by, "x", "y", "value"), None, self.width, self.height
        for k in range(self.levels - 1, -1, -1):
            here = level.withColumn("level", F.lit(k))
            out = here if out is None else out.unionByName(here)
            if k:
                level, w, h = R.half(level, method, w, h, self.by), -(-w // 2), -(-h // 2)
        return out

    def write(self, path: str, method: str = "mean") -> None:
        """The pyramid by level (and frame): a reader of one level reads its files only."""
        p = self.pyramid(method)
        tiles_source.write_tiles(p if "frame" in p.columns else p.withColumn("frame", F.lit(0)), path)
