"""Colours, palettes, padding and canonical keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_colour(text: Column) -> Column:
    """Whether a text is a colour: # and 3, 4, 6 or 8 hexadecimal digits, or rgb() of three whole numbers, or rgba() of these
    and a number of digits with at most one before a point."""
    digits = F.substring(text, 2, 1 << 20)
    by_digits = text.startswith("#") & F.length(digits).isin(3, 4, 6, 8) & (F.length(F.translate(F.lower(digits), "0123456789abcdef", "")) == 0)
    name = F.substring_index(text, "(", 1)
    inner = F.substring(text, F.length(name) + 2, F.greatest(F.length(text) - F.length(name) - 2, F.lit(0)))
    parts = F.transform(F.split(inner, ","), lambda p, k: F.when(k > 0, F.ltrim(p)).otherwise(p))
    number = lambda p: (p != "") & (F.length(F.translate(p, "0123456789", "")) == 0)
    alpha = F.get(parts, F.lit(3))
    before, after = F.substring_index(alpha, ".", 1), F.substring_index(alpha, ".", -1)
    small = number(alpha) | (F.contains(alpha, F.lit(".")) & ((before == "") | number(before) & (F.length(before) == 1)) & number(after) & (F.length(alpha) == F.length(before) + F.length(after) + 1))
    whole = F.forall(F.slice(parts, 1, 3), number)
    called = text.endswith(")") & whole & (((name == "rgb") & (F.size(parts) == 3)) | ((name == "rgba") & (F.size(parts) == 4) & small))
    return F.coalesce(by_digits | called, F.lit(False))


def channels(text: Column) -> Column:
    """Red, green, blue and alpha of #rgb, #rgba, #rrggbb and #rrggbbaa; null for others."""
    body = F.substring(text, 2, 8)
    long = F.when(F.length(body) <= 4, F.regexp_replace(body, "(.)", "$1$1")).otherwise(body)
    full = F.when(F.length(long) == 6, F.concat(long, F.lit("ff"))).otherwise(long)
    part = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int")
    return F.when(text.rlike(r"^#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), F.array(part(1), part(3), part(5), part(7)))


def over_background(value: Column, alpha: Column, background: Column) -> Column:
    """A channel drawn over a background, truncated."""
    return F.floor(value * (alpha / 255.0) + (1 - alpha / 255.0) * background).cast("int")


def equal_padding(size: Column, wanted: Column) -> tuple[Column, Column]:
    """Padding before and after that centres a size in a larger one, the odd pixel after."""
    need = F.greatest(wanted - size, F.lit(0))
    return F.floor(need / 2).cast("long"), F.ceil(need / 2).cast("long")


def edge_padding(size: Column, wanted: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """All the padding on the nearer border."""
    need = F.greatest(wanted - size, F.lit(0))
    near = before < after
    return F.when(near, need).otherwise(0).cast("long"), F.when(near, 0).otherwise(need).cast("long")


def cache_key(*parts: Column, **named: Column) -> Column:
    """One key for positional and named arguments, whatever the names' order."""
    text = [p.cast("string") for p in parts] + [F.concat(F.lit(f"{k}="), named[k].cast("string")) for k in sorted(named)]
    return F.md5(F.concat_ws("|", *text))


def opaque(kind: Column, highest: Column) -> Column:
    """The alpha of an opaque pixel of a number type."""
    return F.when(kind == "uint8", 255.0).when(kind == "uint16", 65535.0).when(kind == "uint32", 4294967295.0).otherwise(F.when(highest <= 1, 1.0).when(highest < 256, 255.0).otherwise(65535.0))
