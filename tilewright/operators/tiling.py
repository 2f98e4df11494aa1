"""Tile grids, scales and regions: the scalar planning of a tiled raster.

Grids are planned from a handful of numbers and generated on executors from a range, so
their size is bound only by the range.  Everything else is a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One axis of a grid: an image of ``size``, a region [start, end), tiles of ``tile`` pixels
    that share ``overlap`` pixels with the next one."""

    size: int
    tile: int
    overlap: int = 0
    start: int = 0
    end: int | None = None
    edges: bool = False
    offset: int = 0

    def __post_init__(self) -> None:
        if self.step <= 0:
            raise ValueError("the overlap must be smaller than the tile")

    @property
    def stop(self) -> int:
        return self.size if self.end is None else self.end

    @property
    def step(self) -> int:
        return self.tile - self.overlap

    @property
    def origin(self) -> int:
        return self.offset + (0 if self.edges else self.overlap // 2)

    @property
    def shared(self) -> int:
        return 0 if self.edges else self.overlap

    @property
    def first(self) -> int:
        return int((self.start - self.offset) / self.step)

    @property
    def last(self) -> int:
        """One past the last tile."""
        return max(-(-(self.stop - self.offset - self.shared) // self.step), self.first + 1)

    @property
    def count(self) -> int:
        return self.last - self.first

    def columns(self, k: Column, near: str, far: str) -> dict[str, Column]:
        """Position, size and overlap of tile ``k``; near and far name the two sides."""
        span = self.stop - self.start
        raw = k * self.step - self.overlap // 2 + self.origin - self.start
        at = F.greatest(raw, F.lit(0))
        size = F.least(raw + self.tile, F.lit(span)) - at
        lead = F.greatest(F.lit(0), k * self.step + self.origin - self.start - at)
        trail = F.greatest(F.lit(0), size - self.step - lead)
        if self.shared:
            trail = F.when(k == self.first, F.least(size, F.lit(self.shared - self.origin))).otherwise(trail)
            lead = F.when(k == self.first, 0).otherwise(lead)
            trail = F.when(k == self.last - 1, 0).otherwise(trail)
        return {"at": at + self.start, "size": size, near: lead, far: trail}


def tile_grid(spark: SparkSession, x: Axis, y: Axis, scale: float = 1.0) -> DataFrame:
    """A row for each tile: position, level_x, level_y, x, y, width, height, the overlap on each
    side, and the same box in base pixels (gx, gy, gwidth, gheight)."""
    ids = spark.range(x.count * y.count)
    kx, ky = F.col("id") % x.count + x.first, F.expr(f"id div {x.count}") + y.first
    cx, cy = x.columns(kx, "left", "right"), y.columns(ky, "top", "bottom")
    return ids.select(
        F.col("id").alias("position"), kx.alias("level_x"), ky.alias("level_y"), cx["at"].alias("x"), cy["at"].alias("y"), cx["size"].alias("width"), cy["size"].alias("height"),
        *[cx[s].cast("long").alias(f"overlap_{s}") for s in ("left", "right")], *[cy[s].cast("long").alias(f"overlap_{s}") for s in ("top", "bottom")],
    ).withColumns({f"g{c}": F.col(c) * float(scale) for c in ("x", "y", "width", "height")})


def pixels_in_tiles(pixels: DataFrame, x: Axis, y: Axis, keep_overlap: bool = True) -> DataFrame:
    """Pixels with the position of each tile that holds them.

    The tiles of a pixel follow from its coordinates, so this explodes each pixel to its few
    tiles in place of joining pixels with tiles by range.  Without ``keep_overlap`` a pixel belongs
    to one tile only, the one whose overlap on each side does not hold it.
    """

    def tiles(axis: Axis, column: str) -> tuple[Column, Column]:
        # Tile k covers [k*step + b, k*step + b + tile) of the region, b as in Axis.columns().
        b = axis.origin - axis.overlap // 2
        p = F.col(column).cast("long")
        low = F.ceil((p - b - axis.tile + 1) / axis.step)
        high = F.floor((p - b) / axis.step)
        return F.greatest(low, F.lit(axis.first)), F.least(high, F.lit(axis.last - 1))

    inside = (F.col("x") >= x.start) & (F.col("x") < x.stop) & (F.col("y") >= y.start) & (F.col("y") < y.stop)
    (x0, x1), (y0, y1) = tiles(x, "x"), tiles(y, "y")
    p = pixels.where(inside).withColumn("tx", F.explode(F.sequence(x0, x1))).withColumn("ty", F.explode(F.sequence(y0, y1)))
    if not keep_overlap:
        for axis, column, tile in ((x, "x", "tx"), (y, "y", "ty")):
            c = axis.columns(F.col(tile), "lead", "trail")
            p = p.where((F.col(column) >= c["at"] + c["lead"]) & (F.col(column) < c["at"] + c["size"] - c["trail"]))
    return p.withColumn("position", F.col("tx") - x.first + (F.col("ty") - y.first) * x.count).drop("tx", "ty")


def half_even(c: Column) -> Column:
    """Round to an integer, halves to the even neighbour."""
    return F.bround(c, 0).cast("long")


def region_bounds(size: Column, scale: Column, low: Column, high: Column, length: Column) -> tuple[Column, Column]:
    """Start and end of a region on one axis, in base pixels, cropped to the image.

    Given values are in units of ``scale`` base pixels; negative edges count from the far side; a
    missing edge follows from the other and the length, or is the image's.
    """
    a, b, n = low * scale, high * scale, length * scale
    a = F.when(a < 0, a + size).otherwise(a)
    b = F.when(b < 0, b + size).otherwise(b)
    start = F.coalesce(a, b - n, F.lit(0.0))
    end = F.coalesce(b, a + n, F.when(low.isNull() & high.isNull(), n), size.cast("double"))
    crop = lambda c: half_even(F.greatest(F.lit(0.0), F.least(c, size.cast("double"))))
    return crop(start), crop(F.greatest(start, end))


def level_scale(levels: Column, level: Column) -> Column:
    """Base pixels for a pixel of a level: 2 ** (levels - 1 - level)."""
    return F.pow(F.lit(2.0), levels - 1 - level)


def level_for_magnification(levels: Column, native: Column, wanted: Column, rounding: str | None = "round", exact: bool = False) -> Column:
    """Level that gives a magnification; null where ``exact`` has none, or ``ceil`` is past the
    top."""
    ratio = F.round(F.log2(wanted / native), 4)
    top = levels - 1
    level = top + ratio
    if rounding == "round":
        level = half_even(level)
    elif rounding == "ceil":
        level = F.ceil(level)
    clamped = F.greatest(F.lit(0), F.least(top, level)).cast("double")
    if exact:
        return F.when((ratio == F.floor(ratio)) & (level <= top) & (level >= 0), clamped)
    return F.when(level <= top, clamped) if rounding == "ceil" else clamped


def fit_size(width: Column, height: Column, most_w: Column, most_h: Column) -> tuple[Column, Column]:
    """Output size within a box, keeping the shape; a missing side is 16 times the other."""
    w = F.coalesce(most_w, most_h * 16)
    h = F.coalesce(most_h, most_w * 16)
    sw = F.greatest(F.lit(1), F.floor(width * h / height)).cast("long")
    sh = F.greatest(F.lit(1), F.floor(height * w / width)).cast("long")
    tall = (sw == w) | ((w * height > h * width) & (sh != h))
    return F.when(tall, sw).otherwise(w), F.when(tall, h).otherwise(sh)


def near_power_of_two(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Whether two numbers of one sign are nearly a power of two apart."""
    steps = F.log2(F.abs(a) / F.abs(b))
    return F.when((a == 0) | (b == 0) | (F.signum(a) != F.signum(b)), False).otherwise(F.abs(steps - F.bround(steps, 0)) < tolerance)


def frame_axes(frame: Column, ranges: dict[str, int]) -> dict[str, Column]:
    """Index on each axis of a linear frame; the first axis varies fastest."""
    out, stride = {}, 1
    for name, n in ranges.items():
        out[name] = F.floor(frame / stride).cast("long") % n
        stride *= n
    return out


def axes_frame(axes: dict[str, Column], ranges: dict[str, int]) -> Column:
    """Linear frame of axis indices; null where one is out of range."""
    total, ok, stride = F.lit(0), F.lit(True), 1
    for name, n in ranges.items():
        total = total + axes[name] * stride
        ok = ok & (axes[name] >= 0) & (axes[name] < n)
        stride *= n
    return F.when(ok, total)


def tile_corners(x: Column, y: Column, z: Column, levels: int, tile_w: int, tile_h: int, size_x: int, size_y: int) -> dict[str, Column]:
    """Base-pixel corners and step of a tile of a level."""
    step = F.pow(F.lit(2), F.lit(levels - 1) - z).cast("long")
    return {"step": step, "x0": x * step * tile_w, "y0": y * step * tile_h, "x1": F.least((x + 1) * step * tile_w, F.lit(size_x)), "y1": F.least((y + 1) * step * tile_h, F.lit(size_y))}


def possible_sizes(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All sizes reached by halving both sides, each with floor or ceiling, to one pixel.

    k halvings of n give its floor or ceiling over 2 ** k and nothing else, so the sizes of
    each k are four and need no search; a side reaches zero only beside one that doesn't.
    """
    steps = max(max(width, height) - 1, 0).bit_length()
    k = spark.range(steps + 1).select(F.pow(F.lit(2), F.col("id")).cast("long").alias("s"))

    def halves(n: int) -> Column:
        return F.explode(F.array_distinct(F.array(F.floor(F.lit(n) / F.col("s")), F.ceil(F.lit(n) / F.col("s")))))

    return k.withColumn("w", halves(width)).withColumn("h", halves(height)).select("w", "h").where("w + h > 0").distinct()


UNITS = ("base_pixels", "fraction", "mag_pixels", "nm", "um", "mm", "m", "km")


def scale_from_units(unit: Column, size: Column, mm: Column, native: Column, wanted: Column) -> Column:
    """Base pixels for one unit of a length; null for a name that is no unit.  ``mm``: millimetres of a pixel;
    ``native`` and ``wanted``: magnifications."""
    metric = {"nm": 1e-6, "um": 1e-3, "mm": 1.0, "m": 1e3, "km": 1e6}
    out = F.when(unit == "base_pixels", 1.0).when(unit == "fraction", size).when(unit == "mag_pixels", native / wanted)
    for name, length in metric.items():
        out = out.when(unit == name, length / mm)
    return out


def convert_scale(value: Column, source: Column, target: Column) -> Column:
    """A length in units of ``source`` base pixels in units of ``target`` ones."""
    return value * source / target


def tile_in_range(x: Column, y: Column, z: Column, frame: Column, levels: int, tile_w: int, tile_h: int, size_x: int, size_y: int, frames: int = 1) -> Column:
    """Whether a level has a tile, and the image the frame."""
    step = F.pow(F.lit(2.0), levels - 1 - z)
    inside = (x >= 0) & (y >= 0) & (x < F.ceil(size_x / (step * tile_w))) & (y < F.ceil(size_y / (step * tile_h)))
    return (z >= 0) & (z < levels) & (frame >= 0) & (frame < frames) & inside
