"""Drawn elements: boxes, the region query, versions, and matches between elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounding_box(df: DataFrame) -> DataFrame:
    """lowx, lowy, highx, highy, size (its diagonal) and details of rectangles (with a rotation),
    circles, points and point lists (``points``: array of struct x, y)."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    kind, cx, cy = F.col("type"), F.col("cx"), F.col("cy")
    turn = F.coalesce(has("rotation").cast("double"), F.lit(0.0))
    s, c = F.abs(F.sin(turn)), F.abs(F.cos(turn))
    w, h = F.col("width") * 0.5, F.col("height") * 0.5
    # The larger extent of the two sides, not their sum: the box drawn by the viewer.
    rw, rh = F.greatest(c * w, s * h), F.greatest(s * w, c * h)
    half_w = F.when(kind == "rectangle", F.when(turn == 0, w).otherwise(rw)).when(kind == "circle", w).otherwise(0.5)
    half_h = F.when(kind == "rectangle", F.when(turn == 0, h).otherwise(rh)).when(kind == "circle", w).otherwise(0.5)
    edges = {"lowx": cx - half_w, "lowy": cy - half_h, "highx": cx + half_w, "highy": cy + half_h}
    details = F.when(kind == "point", 1).otherwise(4)
    if "points" in df.columns:
        line = kind == "polyline"
        for name, axis, ends in (("lowx", "x", F.array_min), ("lowy", "y", F.array_min), ("highx", "x", F.array_max), ("highy", "y", F.array_max)):
            edges[name] = F.when(line, ends(F.col("points")[axis])).otherwise(edges[name])
        details = F.when(line, F.size("points")).otherwise(details)
    out = df.withColumns(edges)
    size = F.sqrt(F.pow(F.col("highy") - F.col("lowy"), 2) + F.pow(F.col("highx") - F.col("lowx"), 2))
    return out.withColumns({"size": size, "details": details})


def in_region(left: float | None = None, right: float | None = None, top: float | None = None, bottom: float | None = None, least_size: float | None = None) -> Column:
    """Boxes that meet a region.  A lower bound of zero or less is no bound."""
    ok = F.lit(True)
    for bound, column in ((left, "highx"), (top, "highy")):
        if bound is not None and bound > 0:
            ok = ok & (F.col(column) >= bound)
    for bound, column in ((right, "lowx"), (bottom, "lowy")):
        if bound is not None:
            ok = ok & (F.col(column) < bound)
    if least_size is not None and least_size > 0:
        ok = ok & (F.col("size") >= least_size)
    return ok


def within_budget(boxes: DataFrame, order: list[Column], most_details: int, least_elements: int = 0) -> DataFrame:
    """The first elements in an order until their details reach a budget; the one that crosses
    it is kept, and at least ``least_elements`` are.

    Every element has a detail, so no more than the larger of the two bounds can be kept: a
    distributed top-k comes first, and the running sum sees only that many rows.
    """
    top = boxes.orderBy(*order).limit(max(most_details, least_elements))
    w = Window.orderBy(*order)
    run = F.coalesce(F.sum("details").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = top.withColumn("prior", run).withColumn("place", F.row_number().over(w))
    return ranked.where((F.col("prior") < most_details) | (F.col("place") <= least_elements)).drop("prior", "place")


def latest(df: DataFrame, by: list[str], version: str, keep: list[str]) -> DataFrame:
    """The row of the greatest version of each key, by a partial maximum."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*keep), version).alias("row"), F.max(version).alias(version))
    return best.select(*by, version, *[F.col(f"row.{c}").alias(c) for c in keep if c != version])


def nth_version(df: DataFrame, by: list[str], version: str, n: int, keep: list[str]) -> DataFrame:
    """The row of the n-th newest version (1: newest) of each key.  Spark keeps only the n first rows of each key before it
    shuffles them, as the rank is bounded."""
    w = Window.partitionBy(*by).orderBy(F.col(version).desc())
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).where(F.col("place") == n).select(*by, version, *[c for c in keep if c != version])


def band_join(a: DataFrame, b: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Pairs of boxes (columns id, x0, y0, x1, y1) whose four edges differ by ``tolerance`` at most.

    Both sides go into cells of the first corner, several times as wide as the tolerance.  A box of one side is in one cell, a box of
    the other in each that its tolerance reaches, mostly one, so equal cells are joined and few rows are sent twice.
    """
    cell = 6 * tolerance + 1
    reach = 1.125 * tolerance  # a little more than the tolerance, so that rounding loses no pair
    names = ("x0", "y0", "x1", "y1")
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in ("id", *names)], F.floor(F.col("x0") / cell).alias("bx"), F.floor(F.col("y0") / cell).alias("by"))
    reached = lambda c: F.explode(F.sequence(F.floor((F.col(f"b_{c}") - reach) / cell), F.floor((F.col(f"b_{c}") + reach) / cell)))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in ("id", *names)]).withColumn("bx", reached("x0")).withColumn("by", reached("y0"))
    close = F.lit(True)
    for e in names:
        close = close & (F.abs(F.col(f"a_{e}") - F.col(f"b_{e}")) <= tolerance)
    return left.join(right, ["bx", "by"]).where(close).drop("bx", "by")
