"""Batches of tiles for models: which to read, how to read them together, and how to fill them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_by_mask(tiles: DataFrame, mask: DataFrame, threshold: float, mask_scale: float = 1.0) -> DataFrame:
    """Tiles whose share of mask pixels above zero exceeds a threshold.

    tiles: position, x, y, width, height on a grid of equal ``step`` columns; mask: x, y, value, a pixel of it standing for
    ``mask_scale`` tile pixels.  A mask pixel finds its tile by arithmetic, so there is no range join.
    """
    m = mask.where("value > 0").select((F.col("x") * mask_scale).alias("mx"), (F.col("y") * mask_scale).alias("my"))
    size = tiles.agg(F.max("width").alias("tw"), F.max("height").alias("th"))
    # One row: the tile's size.
    m = m.join(F.broadcast(size)).select(F.floor(F.col("mx") / F.col("tw")).alias("level_x"), F.floor(F.col("my") / F.col("th")).alias("level_y"))
    hits = m.groupBy("level_x", "level_y").agg((F.count("*") * float(mask_scale) ** 2).alias("covered"))
    found = tiles.join(hits, ["level_x", "level_y"])
    return found.where(F.col("covered") > threshold * F.col("width") * F.col("height")).drop("covered")


def edge_cases(tiles: DataFrame, width: int, height: int, tile_w: int, tile_h: int, edges: str = "keep") -> DataFrame:
    """Windows (x, y) that cross the border: kept with the padding they need, dropped, or moved inside."""
    over_x, over_y = F.greatest(F.col("x") + tile_w - width, F.lit(0)), F.greatest(F.col("y") + tile_h - height, F.lit(0))
    if edges == "drop":
        return tiles.where((over_x == 0) & (over_y == 0)).withColumns({"pad_right": F.lit(0), "pad_bottom": F.lit(0)})
    if edges == "shift":
        moved = tiles.withColumns({"x": F.greatest(F.lit(0), F.col("x") - over_x), "y": F.greatest(F.lit(0), F.col("y") - over_y)})
        return moved.withColumns({"pad_right": F.greatest(F.lit(tile_w - width), F.lit(0)), "pad_bottom": F.greatest(F.lit(tile_h - height), F.lit(0))})
    return tiles.withColumns({"pad_right": over_x, "pad_bottom": over_y})


def grid_chunks(tiles: DataFrame, across: int, down: int) -> DataFrame:
    """Chunks of neighbouring tiles that are read in one go, of full or incomplete grids: the box of the tiles there
    are, their number, and whether the block is whole."""
    by = [F.floor(F.col("level_x") / across).alias("chunk_x"), F.floor(F.col("level_y") / down).alias("chunk_y")]
    box = [F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")]
    return tiles.groupBy(*by).agg(F.count("*").alias("tiles"), *box).withColumn("whole", F.col("tiles") == across * down)


#: Accuracy of approximate quantiles, and the number of values that are sorted at once.
ACCURACY, FEW = 10_000, 4096


def _kth(rows: DataFrame, column: str, k: int, n: int) -> tuple[object, int, int]:
    """The value of rank ``k`` (from 0, nulls last) of a number column of ``n`` rows, the rows below it, and those equal to it.

    Approximate quantiles give an interval around the rank, and exact counts tell in which part of it, or outside, the rank
    falls; that goes on within the part.  Each step is an aggregate with map-side sums, so a task holds no more than a sketch.
    """
    c, below, stuck = F.col(column), 0, False
    while n > FEW:
        share, wide = (k - below) / n, 4.0 / ACCURACY
        ends = [F.min(c), F.max(c)] if stuck else [F.percentile_approx(c, p, ACCURACY) for p in (max(0.0, share - wide), min(1.0, share + wide))]
        low, high = rows.agg(*ends).first()
        if low is None:
            return None, below, n
        parts = [(c < low, None), (c == low, low), ((c > low) & (c < high), None), ((c == high) & (c > low), high), (c > high, None), (c.isNull(), None)]
        counts = rows.agg(*[F.count_if(p) for p, _ in parts]).first()
        for (part, value), count in zip(parts, counts, strict=True):
            if k < below + count:
                break
            below += count
        if value is not None:
            return value, below, count
        # Quantiles are doubles: of whole numbers beyond 2 ** 53 they may be no value of the column.
        rows, stuck, n = rows.where(part), count == n, count
    values = rows.agg(F.sort_array(F.collect_list(c))).first()[0]
    if k - below >= len(values):
        return None, below + len(values), n - len(values)
    v = values[k - below]
    equal = [j for j, w in enumerate(values) if w == v or w != w and v != v]
    return v, below + equal[0], len(equal)


def _upper_half(rows: DataFrame, n: int, order: list[str]) -> tuple[Column, bool]:
    """Whether a row is in the upper half of ``n`` rows in an order, nulls last; and whether no rows that are equal in the order fall into both halves."""
    k = -(-n // 2)
    upper, same = F.lit(False), F.lit(True)
    for column in order:
        value, below, n = _kth(rows.where(same), column, k, n)
        k -= below
        c = F.col(column)
        after = F.lit(False) if value is None else c.isNull() | (c > value)
        upper, same = upper | (same & after), same & c.eqNullSafe(F.lit(value))
    return upper | same, k == 0


def kd_chunks(points: DataFrame, depth: int, x: str = "x", y: str = "y", key: str = "position") -> DataFrame:
    """``chunk`` of scattered tiles by a k-d tree: halves by rank along x and y in turn (number columns, nulls last, ties by
    the number ``key``), ``depth`` times.

    The rows at which the parts are split are searched by aggregates, so nothing is sorted or shuffled; the chunk of a row
    follows from comparisons with these 2 ** depth - 1 rows.  Rows that share a key are numbered first if a split needs it.
    """

    def chunk(part: DataFrame, n: int, level: int, ties: list[str]) -> Column | None:
        """Chunk of the rows of a part of ``n`` rows, among those of its size; none if equal rows would have to be split."""
        if level == depth or n < 2:
            return F.lit(0).cast("long")
        upper, clean = _upper_half(part, n, [y if level % 2 else x, *ties])
        if not clean:
            return None
        high, low = chunk(part.where(upper), n // 2, level + 1, ties), chunk(part.where(~upper), n - n // 2, level + 1, ties)
        if high is None or low is None:
            return None
        return F.when(upper, high + (1 << (depth - 1 - level))).otherwise(low)

    n = points.count()
    found = chunk(points, n, 0, [key])
    if found is not None:
        return points.withColumn("chunk", found)
    numbered = points.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy(x, y)))
    return numbered.withColumn("chunk", chunk(numbered, n, 0, [key, "copy"])).drop("copy")


def batch_plan(tiles: DataFrame, batch: int, chunk: list[str]) -> DataFrame:
    """batch and slot of each tile, chunk after chunk.  Numbers are dealt by chunk offsets, so only the chunks' counts meet in
    one task."""
    counts = tiles.groupBy(*chunk).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*chunk, before.alias("start"))
    own = F.row_number().over(Window.partitionBy(*chunk).orderBy("y", "x")) - 1
    place = F.col("start") + F.col("own")
    rows = tiles.withColumn("own", own).join(starts, chunk)
    return rows.withColumns({"batch": F.floor(place / batch).cast("long"), "slot": (place % batch).cast("int")}).drop("own", "start")


def target_size(size: Column, mm: Column, wanted_mm: Column) -> Column:
    """Pixels of a side at another resolution."""
    return F.greatest(F.lit(1), F.floor(size * mm / wanted_mm)).cast("long")


def smallest_box(points: Column) -> dict[str, Column]:
    """Box of an array of struct(x, y), to whole pixels outwards."""
    return {
        "left": F.floor(F.array_min(F.transform(points, lambda p: p["x"]))).cast("long"), "top": F.floor(F.array_min(F.transform(points, lambda p: p["y"]))).cast("long"),
        "right": F.ceil(F.array_max(F.transform(points, lambda p: p["x"]))).cast("long"), "bottom": F.ceil(F.array_max(F.transform(points, lambda p: p["y"]))).cast("long"),
    }
