"""Queries of tile grids, scales, regions and frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tilewright.operators import tiling as T
from tilewright.plans.registry import query
from tilewright.sources import views as V

W, H = 200, 160
#: Stands in the SQL for the height of the raster, which is read from the table.
PLAIN = (T.Axis(W, 64), T.Axis(H, 64))
OVERLAP = (T.Axis(W, 64, 16), T.Axis(H, 64, 16))
EDGES = (T.Axis(W, 64, 16, edges=True), T.Axis(H, 64, 16, edges=True))


def _axis_sql(axis: T.Axis, c: str, near: str, far: str) -> str:
    """One axis of a grid in SQL, from the same definitions."""
    a = axis
    first, step = a.start - a.offset, a.step
    xmin = f"(SELECT CAST(trunc({first} / {step}.0) AS BIGINT))"
    xmax = f"(SELECT greatest(CAST(ceil(({a.stop} - {a.offset} - {a.shared}) / {step}.0) AS BIGINT), {xmin} + 1))"
    raw = f"(k * {step} - {a.overlap // 2} + {a.origin} - {a.start})"
    lead = f"greatest(0, k * {step} + {a.origin} - {a.start} - p0)"
    inner = f"greatest(0, size - {step} - {lead})"
    trail = f"CASE WHEN k = {xmax} - 1 AND {a.shared} > 0 THEN 0 WHEN k = {xmin} AND {a.shared} > 0 THEN least(size, {a.shared - a.origin}) ELSE {inner} END"
    return f"""{c} AS (SELECT k, k - {xmin} AS i, {xmax} - {xmin} AS n, p0 + {a.start} AS pos, size, CASE WHEN k = {xmin} AND {a.shared} > 0 THEN 0 ELSE {lead} END AS {near}, {trail} AS {far}
      FROM (SELECT k, greatest({raw}, 0) AS p0, least({raw} + {a.tile}, {a.stop} - {a.start}) - greatest({raw}, 0) AS size FROM range({xmin}, {xmax}) t(k)))"""


def grid_sql(x: T.Axis, y: T.Axis, height: str | None = None) -> str:
    """The grid in SQL; ``height``: an expression for the size of the second axis."""
    if height:
        whole = grid_sql(x, T.Axis(987654, y.tile, y.overlap, edges=y.edges))
        return whole.replace("987654", height)
    return f"""WITH {_axis_sql(x, "ax", "l", "r")}, {_axis_sql(y, "ay", "t", "b")}
      SELECT ax.i + ay.i * ax.n AS position, ax.k AS level_x, ay.k AS level_y, ax.pos AS x, ay.pos AS y, ax.size AS width, ay.size AS height,
             ax.l AS overlap_left, ax.r AS overlap_right, ay.t AS overlap_top, ay.b AS overlap_bottom,
             ax.pos * 1.0::DOUBLE AS gx, ay.pos * 1.0::DOUBLE AS gy, ax.size * 1.0::DOUBLE AS gwidth, ay.size * 1.0::DOUBLE AS gheight FROM ax, ay"""


@query(grid_sql(*PLAIN))
def tile_grid(spark, sf_dir):
    return T.tile_grid(spark, *PLAIN)


@query(grid_sql(*OVERLAP))
def tile_grid_overlap(spark, sf_dir):
    return T.tile_grid(spark, *OVERLAP)


@query(grid_sql(*EDGES))
def tile_grid_overlap_edges(spark, sf_dir):
    return T.tile_grid(spark, *EDGES)


REGION = (T.Axis(W, 50, 10, 33, 171), T.Axis(H, 40, 8, 20, 150))


@query(grid_sql(*REGION))
def tile_grid_region(spark, sf_dir):
    return T.tile_grid(spark, *REGION)


@query(f"SELECT count(*)::BIGINT AS tiles FROM ({grid_sql(*OVERLAP)})")
def tile_count(spark, sf_dir):
    return T.tile_grid(spark, *OVERLAP).agg(F.count("*").alias("tiles"))


@query(f"SELECT * FROM ({grid_sql(*OVERLAP)}) WHERE position = 5")
def single_tile(spark, sf_dir):
    return T.tile_grid(spark, *OVERLAP).where("position = 5")


def _tile_join(x: T.Axis, y: T.Axis) -> str:
    return V.with_views("mosaic") + f", g AS ({grid_sql(x, y, V.HEIGHT_SQL)}), p AS (SELECT g.*, m.x AS px, m.y AS py, m.value FROM g JOIN mosaic m ON m.x >= g.x AND m.x < g.x + g.width AND m.y >= g.y AND m.y < g.y + g.height) "


def _whole(spark, sf_dir, axes: tuple[T.Axis, T.Axis]) -> tuple[T.Axis, T.Axis]:
    """The axes with the height of the table's raster."""
    return axes[0], replace(axes[1], size=V.height(spark, sf_dir))


@query(_tile_join(*OVERLAP) + "SELECT position, round(avg(value), 9) AS mean, count(*)::BIGINT AS pixels FROM p GROUP BY position")
def tile_mean(spark, sf_dir):
    """Mean of each tile; pixels in shared margins count in every tile that has them."""
    p = T.pixels_in_tiles(V.mosaic(spark, sf_dir), *_whole(spark, sf_dir, OVERLAP))
    return p.groupBy("position").agg(F.round(F.avg("value"), 9).alias("mean"), F.count("*").alias("pixels"))


@query(_tile_join(*PLAIN) + "SELECT round(sum(m * n) / sum(n), 9) AS mean FROM (SELECT position, avg(value) AS m, count(*) AS n FROM p GROUP BY position)")
def overall_mean(spark, sf_dir):
    """Tile means weighted by tile size."""
    p = T.pixels_in_tiles(V.mosaic(spark, sf_dir), *_whole(spark, sf_dir, PLAIN)).groupBy("position").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return p.agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 9).alias("mean"))


@query(_tile_join(*OVERLAP) + "SELECT position, sum(value::BIGINT * value)::BIGINT AS sumsq, count(*)::BIGINT AS pixels FROM p WHERE px >= x + overlap_left AND px < x + width - overlap_right AND py >= y + overlap_top AND py < y + height - overlap_bottom GROUP BY position")
def tile_sumsq(spark, sf_dir):
    """Sum of squares of each tile without its shared margins."""
    p = T.pixels_in_tiles(V.mosaic(spark, sf_dir), *_whole(spark, sf_dir, OVERLAP), keep_overlap=False)
    return p.groupBy("position").agg(F.sum(F.col("value").cast("long") * F.col("value")).alias("sumsq"), F.count("*").alias("pixels"))


@query(_tile_join(T.Axis(W, 48), T.Axis(H, 48)) + "SELECT position, (px - x)::BIGINT AS tx, (py - y)::BIGINT AS ty, value FROM p")
def retile(spark, sf_dir):
    """Native 8x8 tiles cut anew into 48x48 ones."""
    x, y = _whole(spark, sf_dir, (T.Axis(W, 48), T.Axis(H, 48)))
    p = T.pixels_in_tiles(V.mosaic(spark, sf_dir), x, y)
    return p.select("position", (F.col("x") - F.col("position") % x.count * 48).cast("long").alias("tx"), (F.col("y") - F.expr(f"position div {x.count}") * 48).cast("long").alias("ty"), "value")


#: (key mod 6) -> which of left, right and width a region gives.
@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, 1000 + p_partkey % 500 AS size,
    CASE WHEN p_partkey % 6 IN (0, 1, 4) THEN (p_partkey % 300)::DOUBLE WHEN p_partkey % 6 = 5 THEN -(p_partkey % 300 + 1)::DOUBLE END AS l,
    CASE WHEN p_partkey % 6 IN (0, 2) THEN (p_partkey % 300 + 40.5)::DOUBLE WHEN p_partkey % 6 = 5 THEN -5.0 END AS r,
    CASE WHEN p_partkey % 6 IN (1, 2, 3) THEN p_size + 0.25 END AS w, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.0 END AS k FROM part),
  q AS (SELECT *, CASE WHEN l * k < 0 THEN l * k + size ELSE l * k END AS a, CASE WHEN r * k < 0 THEN r * k + size ELSE r * k END AS b, w * k AS n FROM p),
  v AS (SELECT *, coalesce(a, b - n, 0.0) AS s0, coalesce(b, a + n, CASE WHEN l IS NULL AND r IS NULL THEN n END, size::DOUBLE) AS e0 FROM q)
  SELECT p_partkey, round_even(greatest(0.0, least(s0, size::DOUBLE)), 0)::BIGINT AS lo, round_even(greatest(0.0, least(greatest(s0, e0), size::DOUBLE)), 0)::BIGINT AS hi FROM v""")
def region_bounds(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    k, m = F.col("p_partkey"), F.col("p_partkey") % 6
    low = F.when(m.isin(0, 1, 4), (k % 300).cast("double")).when(m == 5, -(k % 300 + 1).cast("double"))
    high = F.when(m.isin(0, 2), k % 300 + 40.5).when(m == 5, F.lit(-5.0))
    length = F.when(m.isin(1, 2, 3), F.col("p_size") + 0.25)
    lo, hi = T.region_bounds(1000 + k % 500, F.when(k % 2 == 0, 1.0).otherwise(2.0), low, high, length)
    return p.select("p_partkey", lo.alias("lo"), hi.alias("hi"))


MAGS = "SELECT p_partkey, 9 AS levels, 20.0::DOUBLE AS native, (p_size * 1.25 + 0.3)::DOUBLE AS wanted FROM part"


@query(f"""WITH p AS ({MAGS}), r AS (SELECT p_partkey, levels - 1 AS top, round(log2(wanted / native), 4) AS ratio FROM p)
  SELECT p_partkey, greatest(0, least(top, round_even(top + ratio, 0)))::DOUBLE AS nearest,
    CASE WHEN ceil(top + ratio) <= top THEN greatest(0, least(top, ceil(top + ratio)))::DOUBLE END AS upper,
    greatest(0, least(top, top + ratio))::DOUBLE AS part_level FROM r""")
def level_for_mag(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    args = (F.lit(9), F.lit(20.0), F.col("p_size") * 1.25 + 0.3)
    return p.select("p_partkey", T.level_for_magnification(*args).alias("nearest"), T.level_for_magnification(*args, rounding="ceil").alias("upper"), T.level_for_magnification(*args, rounding=None).alias("part_level"))


@query("""SELECT p_partkey, CASE WHEN r = floor(r) AND 8 + r BETWEEN 0 AND 8 THEN (8 + r)::DOUBLE END AS level
  FROM (SELECT p_partkey, round(log2((p_size % 7 + 1) * 5.0::DOUBLE / 40.0::DOUBLE), 4) AS r FROM part)""")
def level_for_mag_exact(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    level = T.level_for_magnification(F.lit(9), F.lit(40.0), (F.col("p_size") % 7 + 1) * 5.0, rounding=None, exact=True)
    return p.select("p_partkey", level.alias("level"))


@query("SELECT l AS level, pow(2.0, 8 - l)::DOUBLE AS scale, 40.0 / pow(2.0, 8 - l) AS magnification, 0.00025 * pow(2.0, 8 - l) AS mm FROM range(9) t(l)")
def mag_for_level(spark, sf_dir):
    s = T.level_scale(F.lit(9), F.col("id"))
    return spark.range(9).select(F.col("id").alias("level"), s.alias("scale"), (40.0 / s).alias("magnification"), (0.00025 * s).alias("mm"))


@query("SELECT l AS wanted, (SELECT min(p) FROM (VALUES (0), (3), (6), (8)) v(p) WHERE p >= l)::BIGINT AS level FROM range(9) t(l)")
def preferred_level(spark, sf_dir):
    """Next level that is stored, at or above the one wanted."""
    stored = F.array(*[F.lit(x) for x in (0, 3, 6, 8)])
    return spark.range(9).select(F.col("id").alias("wanted"), F.array_min(F.filter(stored, lambda p: p >= F.col("id"))).cast("long").alias("level"))


@query("""SELECT p_partkey, p_size / s AS x, p_size * 2 / s AS width, round(p_size * 0.5::DOUBLE * 0.001::DOUBLE / 0.00025::DOUBLE, 9) AS from_mm
  FROM (SELECT *, (CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 4.0 END)::DOUBLE AS s FROM part)""")
def convert_region_scale(spark, sf_dir):
    """A region and a point of base pixels in a coarser level's, and from micrometres."""
    s = F.when(F.col("p_partkey") % 3 == 0, 1.0).when(F.col("p_partkey") % 3 == 1, 2.0).otherwise(4.0)
    return V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / s).alias("x"), (F.col("p_size") * 2 / s).alias("width"), F.round(F.col("p_size") * 0.5 * 0.001 / 0.00025, 9).alias("from_mm"))


@query("""WITH p AS (SELECT p_partkey, (p_size * 37 + 5)::BIGINT AS rw, (p_size % 9 * 53 + 7)::BIGINT AS rh, 256::BIGINT AS w, CASE WHEN p_partkey % 3 > 0 THEN (100 + p_partkey % 200)::BIGINT END AS hh FROM part),
  q AS (SELECT *, coalesce(hh, w * 16) AS h FROM p), s AS (SELECT *, greatest(1, floor(rw * h / rh))::BIGINT AS sw, greatest(1, floor(rh * w / rw))::BIGINT AS sh FROM q)
  SELECT p_partkey, CASE WHEN sw = w OR (w * rh > h * rw AND sh <> h) THEN sw ELSE w END AS width, CASE WHEN sw = w OR (w * rh > h * rw AND sh <> h) THEN h ELSE sh END AS height FROM s""")
def fit_width_height(spark, sf_dir):
    k = F.col("p_partkey")
    w, h = T.fit_size((F.col("p_size") * 37 + 5).cast("long"), (F.col("p_size") % 9 * 53 + 7).cast("long"), F.lit(256).cast("long"), F.when(k % 3 > 0, (100 + k % 200).cast("long")))
    return V.table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT a, b, abs(log2(a / b::DOUBLE) - round_even(log2(a / b::DOUBLE), 0)) < 0.02 AS near FROM range(1, 65) x(a), range(1, 65) y(b)")
def near_power_of_two(spark, sf_dir):
    ids = spark.range(64 * 64).select((F.expr("id div 64") + 1).alias("a"), (F.col("id") % 64 + 1).alias("b"))
    return ids.select("a", "b", T.near_power_of_two(F.col("a"), F.col("b")).alias("near"))


RANGES = {"c": 5, "z": 25, "t": 2}


@query("SELECT f AS frame, f % 5 AS c, f // 5 % 25 AS z, f // 125 % 2 AS t FROM range(250) x(f)")
def frame_to_axes(spark, sf_dir):
    return spark.range(250).select(F.col("id").alias("frame"), *[c.alias(n) for n, c in T.frame_axes(F.col("id"), RANGES).items()])


@query("SELECT k, CASE WHEN k % 7 < 5 AND k % 30 < 25 AND k % 3 < 2 THEN k % 7 + k % 30 * 5 + k % 3 * 125 END AS frame FROM range(1000) x(k)")
def axes_to_frame(spark, sf_dir):
    k = F.col("id")
    return spark.range(1000).select(k.alias("k"), T.axes_frame({"c": k % 7, "z": k % 30, "t": k % 3}, RANGES).alias("frame"))


AXES_SQL = "SELECT f, f % 5 AS c, f // 5 % 25 AS z, f // 125 AS t FROM range(250) x(f)"


@query(f"""WITH a AS ({AXES_SQL}), u AS (SELECT f, 'c' AS axis, c AS i FROM a UNION ALL SELECT f, 'z', z FROM a UNION ALL SELECT f, 't', t FROM a)
  SELECT axis, (max(i) + 1)::BIGINT AS index_range, min(f) FILTER (i = 1) AS index_stride FROM u GROUP BY axis HAVING max(i) > 0""")
def frame_index_range_stride(spark, sf_dir):
    """Range and stride of each axis that has more than one index."""
    a = spark.range(250).select("id", F.explode(F.create_map(*[x for n, c in T.frame_axes(F.col("id"), RANGES).items() for x in (F.lit(n), c)])).alias("axis", "i"))
    return a.groupBy("axis").agg((F.max("i") + 1).alias("index_range"), F.min(F.when(F.col("i") == 1, F.col("id"))).alias("index_stride")).where("index_range > 1")


@query(f"""WITH a AS ({AXES_SQL}), l AS (SELECT f, c, z, t, CASE WHEN z <> lag(z) OVER (ORDER BY f) OR t <> lag(t) OVER (ORDER BY f) THEN 1 ELSE 0 END AS step FROM a)
  SELECT f AS frame, c, (sum(step) OVER (ORDER BY f))::BIGINT AS island FROM l""")
def frame_index(spark, sf_dir):
    """Index that grows when an axis other than the channel changes."""
    from pyspark.sql import Window

    w = Window.orderBy("frame")
    a = spark.range(250).select(F.col("id").alias("frame"), *[c.alias(n) for n, c in T.frame_axes(F.col("id"), RANGES).items()])
    step = F.coalesce(((F.col("z") != F.lag("z").over(w)) | (F.col("t") != F.lag("t").over(w))).cast("long"), F.lit(0))
    return a.withColumn("step", step).select("frame", "c", F.sum("step").over(w).alias("island"))


@query(V.with_views("frames") + "SELECT frame, count(*)::BIGINT AS pixels, count(DISTINCT value)::BIGINT AS n_values, count(DISTINCT value) = 1 AS uniform, min(value) AS low, max(value) AS high FROM frames GROUP BY frame")
def frame_value_info(spark, sf_dir):
    f = V.frames(spark, sf_dir)
    return f.groupBy("frame").agg(F.count("*").alias("pixels"), F.countDistinct("value").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high")).withColumn("uniform", F.col("n_values") == 1)


@query("""SELECT k AS tile, z, s AS step, x * s * 64 AS x0, y * s * 64 AS y0, least((x + 1) * s * 64, 5000)::BIGINT AS x1, least((y + 1) * s * 64, 3000)::BIGINT AS y1
  FROM (SELECT k, k % 7 AS z, pow(2, 6 - k % 7)::BIGINT AS s, k // 7 % 5 AS x, k // 35 AS y FROM range(280) t(k))""")
def tile_corners(spark, sf_dir):
    k = F.col("id")
    c = T.tile_corners(F.expr("id div 7") % 5, F.expr("id div 35"), k % 7, 7, 64, 64, 5000, 3000)
    return spark.range(280).select(k.alias("tile"), (k % 7).alias("z"), *[v.cast("long").alias(n) for n, v in c.items()])


@query("""WITH RECURSIVE s(w, h) AS (SELECT 1003::BIGINT, 517::BIGINT UNION
  SELECT a, b FROM (SELECT unnest([w // 2, (w + 1) // 2]) AS a, h FROM s WHERE w > 1 OR h > 1) x, LATERAL (SELECT unnest([h // 2, (h + 1) // 2]) AS b)) SELECT DISTINCT w, h FROM s""")
def possible_sizes(spark, sf_dir):
    return T.possible_sizes(spark, 1003, 517)


@query(f"""SELECT level_x // 2 AS bx, level_y // 2 AS by, count(*)::BIGINT AS tiles, min(x)::BIGINT AS x0, max(x + width)::BIGINT AS x1, min(y)::BIGINT AS y0, max(y + height)::BIGINT AS y1 FROM ({grid_sql(*PLAIN)}) GROUP BY 1, 2""")
def read_chunks(spark, sf_dir):
    """Tiles of a full grid read together in 2x2 blocks."""
    g = T.tile_grid(spark, *PLAIN)
    by = [F.expr("level_x div 2").alias("bx"), F.expr("level_y div 2").alias("by")]
    ends = g.groupBy(*by)
    return ends.agg(F.count("*").alias("tiles"), F.min("x").cast("long").alias("x0"), F.max(F.col("x") + F.col("width")).cast("long").alias("x1"), F.min("y").cast("long").alias("y0"), F.max(F.col("y") + F.col("height")).cast("long").alias("y1"))


@query("SELECT count(*) FILTER (x + 64 <= 200 AND y + 64 <= 160)::BIGINT AS kept, count(*) FILTER (x + 64 > 200 OR y + 64 > 160)::BIGINT AS dropped FROM (SELECT i * 32 AS x, j * 32 AS y FROM range(7) a(i), range(5) b(j))")
def edge_filter(spark, sf_dir):
    """Windows that cross the image's border are counted and dropped."""
    w = spark.range(35).select((F.col("id") % 7 * 32).alias("x"), (F.expr("id div 7") * 32).alias("y"))
    inside = (F.col("x") + 64 <= W) & (F.col("y") + 64 <= H)
    return w.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query(V.with_views("element") + "SELECT id, round(sqrt(cx * cx + cy * cy), 6) AS distance, row_number() OVER (ORDER BY cx * cx + cy * cy, id) AS place FROM element QUALIFY place <= 200")
def region_sort_by_distance(spark, sf_dir):
    """The 200 regions nearest to the origin, in order: a bounded top-k before it is numbered."""
    from pyspark.sql import Window

    e = V.element(spark, sf_dir).withColumn("d", F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    top = e.select("id", "d").orderBy("d", "id").limit(200)
    return top.select("id", F.round(F.sqrt("d"), 6).alias("distance"), F.row_number().over(Window.orderBy("d", "id")).cast("long").alias("place"))


@query("""WITH f AS (SELECT f, f % 4 * 64 AS x, f // 4 * 64 AS y FROM range(10) t(f)) SELECT f AS frame, x AS left_px, y AS top_px, x + 64 AS right_px, y + 64 AS bottom_px FROM f""")
def quad_info(spark, sf_dir):
    """Where each of ten frames lies in a texture of ceil(sqrt(n)) frames across."""
    import math

    across = math.ceil(math.sqrt(10))
    f = spark.range(10).select(F.col("id").alias("frame"), (F.col("id") % across * 64).alias("left_px"), (F.expr(f"id div {across}") * 64).alias("top_px"))
    return f.withColumns({"right_px": F.col("left_px") + 64, "bottom_px": F.col("top_px") + 64})
