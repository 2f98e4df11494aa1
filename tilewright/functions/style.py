"""Per-pixel expressions: ranges, palettes, masks, colour spaces and compositing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescale(v: Column, low: float, high: float) -> Column:
    """0 at low and 1 at high; a range of no width counts as one wide."""
    return (v - low) / ((high - low) or 1.0)


def linear(v: Column, stops: list[float]) -> Column:
    """A palette channel by interpolation between equally spaced stops, ends held."""
    n = len(stops) - 1
    t = F.greatest(F.lit(0.0), F.least(F.lit(float(n)), v * n))
    k = F.least(F.floor(t), F.lit(n - 1)).cast("int")
    a = F.array(*[F.lit(float(s)) for s in stops])
    return F.get(a, k) + (F.get(a, k + 1) - F.get(a, k)) * (t - k)


def discrete(v: Column, stops: list[float]) -> Column:
    """A palette channel by equal steps."""
    k = F.greatest(F.lit(0), F.least(F.lit(len(stops) - 1), F.floor(v * len(stops)))).cast("int")
    return F.get(F.array(*[F.lit(float(s)) for s in stops]), k)


def visible(raw: Column, v: Column, nodata: float | None = None, clamp: bool = True) -> Column:
    """Whether a pixel is drawn: not nodata, and without clamping within the range."""
    ok = F.lit(True) if nodata is None else raw != nodata
    return ok if clamp else ok & (v >= 0) & (v <= 1)


def lighten(*bands: Column) -> Column:
    return F.greatest(*bands)


def multiply(first: Column, *others: Column) -> Column:
    """The first band times the others' shares of 255."""
    for band in others:
        first = first * (band / 255.0)
    return first


def over(top: Column, top_alpha: Column, base: Column, base_alpha: Column) -> tuple[Column, Column]:
    """Colour and alpha (0 to 1) of one layer over another."""
    alpha = top_alpha + base_alpha * (1 - top_alpha)
    return (top * top_alpha + base * base_alpha * (1 - top_alpha)) / F.when(alpha == 0, 1.0).otherwise(alpha), alpha


def hsi(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 1), saturation and intensity of red, green and blue in 0 to 1."""
    intensity = (r + g + b) / 3
    low = F.least(r, g, b)
    saturation = F.when(intensity == 0, 0.0).otherwise(1 - low / intensity)
    hue = F.atan2(F.sqrt(F.lit(3.0)) * (g - b), 2 * r - g - b) / (2 * 3.141592653589793)
    return F.when(hue < 0, hue + 1).otherwise(hue), saturation, intensity


def label_bytes(v: Column) -> tuple[Column, Column, Column]:
    """The three bytes, low first, of an integer label."""
    return v % 256, F.floor(v / 256).cast("long") % 256, F.floor(v / 65536).cast("long") % 256
