"""Regions of a raster at another size: by area for smaller ones, by interpolation for larger ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(p: Column, size: int, out: int) -> Column:
    """Output cells that input pixel ``p`` of ``size`` reaches, with the length it has in each."""
    ratio = out / size
    low, high = p * ratio, (p + 1) * ratio
    first = F.floor(low).cast("long")
    last = F.least(F.ceil(high).cast("long") - 1, F.lit(out - 1).cast("long"))
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("k"), (F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))).alias("w")))


def region_area(pixels: DataFrame, left: int, top: int, width: int, height: int, out_w: int, out_h: int, by: list[str] | None = None) -> DataFrame:
    """A region as the mean of what lies under each output pixel, weighted by area.

    A pixel reaches at most a few cells when the region shrinks, so each is sent to its cells and
    summed with map-side sums; nothing is joined.
    """
    by = by or []
    p = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    p = p.withColumn("cx", F.explode(_cells(F.col("x") - left, width, out_w))).withColumn("cy", F.explode(_cells(F.col("y") - top, height, out_h)))
    weight = F.col("cx.w") * F.col("cy.w")
    cells = p.groupBy(*by, F.col("cx.k").alias("x"), F.col("cy.k").alias("y"))
    return cells.agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))


def _taps(size: int, out: int, kernel: str) -> Column:
    """For output index ``id`` the input pixels and weights that make it."""
    at = (F.col("id") + 0.5) * (size / out) - 0.5
    base = F.floor(at)
    t = at - base
    if kernel == "bilinear":
        taps = [(0, 1 - t), (1, t)]
    elif kernel == "bicubic":  # the cubic convolution of parameter -0.5
        near = lambda d: (1.5 * d - 2.5) * d * d + 1
        far = lambda d: ((-0.5 * d + 2.5) * d - 4) * d + 2
        taps = [(-1, far(1 + t)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))]
    else:
        raise ValueError(f"unknown kernel {kernel}")
    clamp = lambda k: F.greatest(F.lit(0), F.least(F.lit(size - 1), (base + k).cast("long"))).cast("long")
    return F.array(*[F.struct(clamp(k).alias("k"), w.alias("w")) for k, w in taps])


def region_interpolated(pixels: DataFrame, left: int, top: int, width: int, height: int, out_w: int, out_h: int, kernel: str = "bilinear", by: list[str] | None = None) -> DataFrame:
    """A region at a larger size, by bilinear or bicubic interpolation; edges are held.

    The weights of each axis are a table as long as the output's side.  The region's pixels meet
    them by equi-joins on x and then on y, and the products are summed.
    """
    by = by or []
    spark = pixels.sparkSession

    def axis(size: int, out: int, name: str) -> DataFrame:
        taps = spark.range(out).select(F.col("id").alias(f"o{name}"), F.explode(_taps(size, out, kernel)).alias("t"))
        return taps.select(f"o{name}", F.col("t.k").alias(f"i{name}"), F.col("t.w").alias(f"w{name}"))

    p = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    p = p.select(*by, (F.col("x") - left).cast("long").alias("ix"), (F.col("y") - top).cast("long").alias("iy"), "value")
    rows = p.join(axis(width, out_w, "x"), "ix").groupBy(*by, "ox", "iy").agg(F.sum(F.col("value") * F.col("wx")).alias("value"))
    out = rows.join(axis(height, out_h, "y"), "iy").groupBy(*by, "ox", "oy").agg(F.sum(F.col("value") * F.col("wy")).alias("value"))
    return out.select(*by, F.col("ox").alias("x"), F.col("oy").alias("y"), "value")


def region_at(pixels: DataFrame, left: int, top: int, width: int, height: int, out_w: int, out_h: int, by: list[str] | None = None) -> DataFrame:
    """By area where the region shrinks, bilinear where it grows."""
    if out_w <= width and out_h <= height:
        return region_area(pixels, left, top, width, height, out_w, out_h, by)
    return region_interpolated(pixels, left, top, width, height, out_w, out_h, "bilinear", by)
