"""Pixel rasters in long form: statistics, histograms, pyramids, regions, compositing.

A raster is a table (group columns.., x, y, value).  Aggregates have map-side sums, so a raster of
any size shuffles one row for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_stats(pixels: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """min, max, mean, stdev (of the population) and samples of each group, in one pass."""
    v = F.col(value).cast("double")
    return pixels.groupBy(*(by or [])).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(v) / F.count(v)).alias("mean"), F.stddev_pop(v).alias("stdev"), F.count(v).alias("samples")
    )


def histogram(pixels: DataFrame, bins: int, by: list[str] | None = None, low: float | None = None, high: float | None = None, density: bool = False, rounded: bool = False) -> DataFrame:
    """bin, count, edge0, edge1 (and density) of each group.

    The range is [min, max + 1] unless given; the last edge belongs to the last bin, values
    outside are left out.  ``rounded`` makes the step an integer when the range is narrow.
    """
    by = by or []
    lo, hi = (F.lit(float(low)) if low is not None else F.min("value").cast("double")), (F.lit(float(high)) if high is not None else F.max("value") + 1.0)
    limits = pixels.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))
    n = F.lit(float(bins))
    if rounded:
        step = F.ceil((F.col("hi") - F.col("lo")) / bins)
        narrow = (F.col("hi") - F.col("lo")) < 10 * bins
        count = F.when(narrow, F.ceil((F.col("hi") - F.col("lo")) / step)).otherwise(bins)
        limits = limits.withColumn("n", count.cast("double")).withColumn("hi", F.when(narrow, F.col("lo") + step * F.col("n")).otherwise(F.col("hi")))
        n = F.col("n")
    # One row for each group: of the size of the groups, not of the pixels.
    rows = pixels.join(limits, by) if by else pixels.crossJoin(F.broadcast(limits))
    place = F.floor((F.col("value") - F.col("lo")) * n / (F.col("hi") - F.col("lo"))).cast("long")
    rows = rows.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))).withColumn("bin", F.least(place, n.cast("long") - 1))
    width = (F.col("hi") - F.col("lo")) / n
    out = rows.groupBy(*by, "bin").agg(F.count("*").alias("count"), F.first(F.col("lo") + 0.0).alias("lo"), F.first(width).alias("width"))
    out = out.select(*by, "bin", "count", (F.col("lo") + F.col("bin") * F.col("width")).alias("edge0"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("edge1"))
    if density:
        out = out.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))
    return out


def threshold(hist: DataFrame, fraction: float, ends: DataFrame, from_max: bool = False) -> DataFrame:
    """The edge at which the running count from one end first passes a fraction of all; the
    value of that end if it is the first bin.  ``hist`` is one histogram: bounded by its bins; ``ends``: one row of
    low and high, the values of the ends."""
    order = Window.orderBy(F.col("bin").desc() if from_max else F.col("bin"))
    run = hist.withColumn("run", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(order))
    run = run.withColumn("all", F.sum("count").over(Window.partitionBy())).where(F.col("run") > fraction * F.col("all"))
    first = run.agg(F.min_by(F.struct("rank", "edge0", "edge1"), "rank").alias("f")).crossJoin(F.broadcast(ends))
    edge = F.col("f.edge1") if from_max else F.col("f.edge0")
    return first.select(F.when(F.col("f.rank") == 1, F.col("high") if from_max else F.col("low")).otherwise(edge).cast("double").alias("threshold"))


#: Cells of a canvas that a task generates.
CANVAS_TASK = 1 << 23

METHODS = ("mean", "median", "max", "min", "nearest", "mode", "maxcolor", "mincolor")


def half(pixels: DataFrame, method: str, width: int, height: int, by: list[str] | None = None) -> DataFrame:
    """The raster at half size by 2x2 blocks; an odd last row or column counts twice.

    Integers truncate.  ``mode`` takes the second value of a block if it equals the third or fourth, the
    third if it equals the fourth, else the first (order: down, then across).
    """
    by = by or []
    p = pixels.select(*by, "x", "y", "value")
    if method == "nearest":
        return p.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select(*by, F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y"), "value")
    # The last pixel of an odd side stands for its missing neighbour as well.
    xs = F.when((F.col("x") == width - 1) & F.lit(width % 2 == 1), F.array("x", F.col("x") + 1)).otherwise(F.array("x"))
    ys = F.when((F.col("y") == height - 1) & F.lit(height % 2 == 1), F.array("y", F.col("y") + 1)).otherwise(F.array("y"))
    if width % 2:
        p = p.withColumn("x", F.explode(xs))
    if height % 2:
        p = p.withColumn("y", F.explode(ys))
    place = (F.col("x") % 2 * 2 + F.col("y") % 2).cast("int")
    block = p.groupBy(*by, F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y"))
    simple = {"mean": F.avg("value"), "median": F.median("value"), "max": F.max("value"), "min": F.min("value")}
    if method in simple:
        return block.agg(F.floor(simple[method]).cast("int").alias("value"))
    values = block.agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), "value"))).alias("v"))
    q = [F.col("v")[k]["value"] for k in range(4)]
    if method == "mode":
        picked = F.when((q[1] == q[2]) | (q[1] == q[3]), q[1]).when(q[2] == q[3], q[2]).otherwise(q[0])
        return values.select(*by, "x", "y", picked.alias("value"))
    raise ValueError(f"unknown method {method}")


def half_by_colour(pixels: DataFrame, largest: bool = True) -> DataFrame:
    """Half size of a raster (band, x, y, value): of each 2x2 block the pixel whose bands have the largest
    (or smallest) sum, the first one on ties."""
    place = (F.col("x") % 2 * 2 + F.col("y") % 2).cast("int")
    whole = pixels.groupBy("x", "y").agg(F.sum("value").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", "value"))).alias("bands"))
    key = F.struct((F.col("total") if largest else -F.col("total")).alias("t"), (-place).alias("k"))
    best = whole.groupBy(F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.max_by("bands", key).alias("bands"))
    return best.select("x", "y", F.explode("bands").alias("band", "value"))


def region_nearest(pixels: DataFrame, left: int, top: int, width: int, height: int, out_w: int, out_h: int) -> DataFrame:
    """A region at another size by nearest pixel: output i shows input floor(i * size / out).
    An output with a side of no pixels is empty."""
    spark = pixels.sparkSession

    def axis(n: int, size: int, name: str) -> DataFrame:
        # Which outputs an input feeds is bounded by the output's sides.
        ids = spark.range(0, max(n, 0), 1, 1)
        return ids.select(F.col("id").alias(f"o{name}"), F.floor(F.col("id") * size / max(n, 1)).cast("long").alias(f"i{name}"))

    xs, ys = axis(out_w, width, "a"), axis(out_h, height, "b")
    p = pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    p = p.withColumns({"rx": F.col("x") - left, "ry": F.col("y") - top})
    p = p.join(F.broadcast(xs), F.col("rx") == F.col("ia")).join(F.broadcast(ys), F.col("ry") == F.col("ib"))
    return p.select(F.col("oa").alias("x"), F.col("ob").alias("y"), "value")


def on_canvas(pixels: DataFrame, width: int, height: int, canvas_w: int, canvas_h: int, left: int, top: int, fill: int) -> DataFrame:
    """A raster (x, y, value of its width and height) on a larger canvas at left and top, the rest filled, as are its missing pixels.

    Only the raster's own cells are joined with its pixels.  What lies around it, which grows with the canvas and so may grow
    with the square of the raster's side, is generated from ranges and never shuffled.
    """
    spark = pixels.sparkSession
    ids = lambda n: spark.range(0, n, 1, max(1, -(-n // CANVAS_TASK)))
    # Rows above and below, then the cells beside the raster.
    y = F.expr(f"id div {canvas_w}")
    above = ids(canvas_w * (canvas_h - height)).select((F.col("id") % canvas_w).alias("x"), F.when(y < top, y).otherwise(y + height).alias("y"))
    beside = canvas_w - width
    x = F.col("id") % max(beside, 1)
    sides = ids(beside * height).select(F.when(x < left, x).otherwise(x + width).alias("x"), (F.expr(f"id div {max(beside, 1)}") + top).alias("y"))
    around = above.unionByName(sides).select("x", "y", F.lit(fill).alias("value"))
    cells = ids(width * height).select((F.col("id") % width).alias("x"), F.expr(f"id div {width}").alias("y"))
    own = cells.join(pixels.select("x", "y", "value"), ["x", "y"], "left")
    return own.select((F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), F.coalesce("value", F.lit(fill)).alias("value")).unionByName(around)


def median_filter(pixels: DataFrame, kernel: int = 5, weight: float = 1.0, top: float = 255.0) -> DataFrame:
    """v + (v - median of the kernel) * weight, clipped; the border uses the pixels there are.

    Each pixel is sent to the kernel cells that it touches (kernel ** 2 rows), in place of a range
    join of the raster with itself.
    """
    r = kernel // 2
    near = F.sequence(F.lit(-r), F.lit(r))
    sent = pixels.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    sent = sent.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "value", F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("value")).alias("own"))
    out = sent.groupBy("x", "y").agg(F.median("value").alias("m"), F.max("own").alias("own")).where("own IS NOT NULL")
    return out.select("x", "y", F.greatest(F.lit(0.0), F.least(F.lit(top), F.col("own") + (F.col("own") - F.col("m")) * weight)).alias("value"))


def error_metrics(a: DataFrame, b: DataFrame, top: float = 255.0) -> DataFrame:
    """Greatest and mean absolute error, root mean square, and peak signal-to-noise (null
    if equal) of two rasters on the same pixels."""
    d = a.select("x", "y", F.col("value").cast("double").alias("a")).join(b.select("x", "y", F.col("value").cast("double").alias("b")), ["x", "y"])
    e = F.col("a") - F.col("b")
    out = d.agg(F.max(F.abs(e)).alias("max_error"), F.avg(F.abs(e)).alias("mean_error"), F.avg(e * e).alias("mse"))
    return out.select("max_error", F.round("mean_error", 9).alias("mean_error"), F.round(F.sqrt("mse"), 9).alias("rmse"), F.when(F.col("mse") > 0, F.round(10 * F.log10(F.lit(top * top) / F.col("mse")), 9)).alias("psnr"))


def output_type(low: Column, high: Column) -> Column:
    """struct(format, offset, multiplier): the integer type that a range of floats goes into."""
    power = lambda v, n: F.pow(F.lit(2.0), -(F.ceil(F.log2(v)) - n)) - F.pow(F.lit(2.0), -F.ceil(F.log2(v)))
    kind = lambda f, o, m: F.struct(F.lit(f).alias("format"), F.lit(float(o)).alias("offset"), (m if isinstance(m, Column) else F.lit(float(m))).alias("multiplier"))
    tiny = 2.0**-8
    return (
        F.when((low >= 0) & (high == 0), kind("uchar", 0, 1))
        .when((low >= 0) & (high <= tiny), kind("ushort", 0, power(high, 16)))
        .when((low >= 0) & (high <= 1), kind("ushort", 0, 65535))
        .when((low >= 0) & (high < 256), kind("uchar", 0, 1))
        .when((low >= 0) & (high < 65536), kind("ushort", 0, 1))
        .when(low >= 0, kind("ushort", 0, power(high, 16)))
        .when((low >= -tiny) & (high <= tiny), kind("ushort", 1, power(high, 15)))
        .when((low >= -1) & (high <= 1), kind("ushort", 1, 32767))
        .when((low >= -32768) & (high < 32768), kind("ushort", 32768, 1))
        .otherwise(kind("ushort", 0, power(F.greatest(-low, high), 16)))
    )


def last_write(writes: DataFrame, keys: list[str], order: str = "seq", value: str = "value") -> DataFrame:
    """The value of the last write to each key: one partial maximum, no sort of the writes."""
    return writes.groupBy(*keys).agg(F.max_by(value, order).alias(value))
