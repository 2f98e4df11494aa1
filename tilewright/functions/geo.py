"""Projected coordinates: affine transforms, the spherical Mercator projection, distances, wrapped bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the spherical Mercator projection and of the law of cosines, in metres.
MERCATOR_RADIUS = 6378137.0
SPHERE_RADIUS = 6.378e6
#: Latitudes beyond this have no place in a square Mercator world.
MERCATOR_LATITUDE = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)


def affine(transform: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel: transform is (x0, dx/dcol, dx/drow, y0, dy/dcol, dy/drow)."""
    x0, xc, xr, y0, yc, yr = (float(v) for v in transform)
    return x0 + xc * x + xr * y, y0 + yc * x + yr * y


def affine_inverse(transform: tuple[float, ...], px: Column, py: Column, whole: bool = False) -> tuple[Column, Column]:
    """Pixel of map coordinates; ``whole`` rounds halves to even."""
    x0, xc, xr, y0, yc, yr = (float(v) for v in transform)
    det = xc * yr - xr * yc
    dx, dy = px - x0, py - y0
    col, row = (dx * yr - dy * xr) / det, (dy * xc - dx * yc) / det
    return (F.bround(col, 0).cast("long"), F.bround(row, 0).cast("long")) if whole else (col, row)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lat = F.greatest(F.lit(-MERCATOR_LATITUDE), F.least(F.lit(MERCATOR_LATITUDE), lat))
    return MERCATOR_RADIUS * F.radians(lon), MERCATOR_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - math.pi / 2)


def tile_extent(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Projected box of a tile of the square Mercator world, y downwards from the north."""
    half = math.pi * MERCATOR_RADIUS
    side = 2 * half / F.pow(F.lit(2.0), z)
    return {"xmin": x * side - half, "xmax": (x + 1) * side - half, "ymin": half - (y + 1) * side, "ymax": half - y * side}


def arc_metres(lat_a: Column, lat_b: Column, dlon: Column) -> Column:
    """Distance on a sphere by the law of cosines; angles in degrees."""
    a, b, d = F.radians(lat_a), F.radians(lat_b), F.radians(dlon)
    return SPHERE_RADIUS * F.acos(F.least(F.lit(1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))


def offset(lon: Column, lat: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The point some metres east and north, on a sphere."""
    return lon + F.degrees(east / (SPHERE_RADIUS * F.cos(F.radians(lat)))), lat + F.degrees(north / SPHERE_RADIUS)


def wrapped(lon: Column) -> Column:
    """A longitude in [-180, 180)."""
    return lon + 180 - 360 * F.floor((lon + 180) / 360) - 180


def bounds(corners: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Box of corners in longitude and latitude, wrapped and kept off the poles."""
    lon = [wrapped(c) for c, _ in corners]
    lat = [F.greatest(F.lit(-89.999999), F.least(F.lit(89.999999), c)) for _, c in corners]
    return {"west": F.least(*lon), "east": F.greatest(*lon), "south": F.least(*lat), "north": F.greatest(*lat)}
