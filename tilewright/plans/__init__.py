"""Queries by theme; importing this package fills the catalogue."""

from tilewright.plans import catalog, elements, extras, raster, tiling, wider  # noqa: F401
from tilewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
