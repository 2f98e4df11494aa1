"""Queries of resampling, projections, style documents, the annotation store, batches and GeoJSON of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geo as G
from tilewright.functions import geojson as J
from tilewright.functions import style_document as D
from tilewright.operators import batches as B
from tilewright.operators import resample as RS
from tilewright.operators import store as ST
from tilewright.operators import tiling as T
from tilewright.plans.raster import _W3, _wide
from tilewright.plans.registry import query
from tilewright.sources import views as V

M = V.with_views("mosaic")


@query(M + """, p AS (SELECT x - 16 AS x, y - 24 AS y, value FROM mosaic WHERE x BETWEEN 16 AND 135 AND y BETWEEN 24 AND 123),
  a AS (SELECT k, i, least((i + 1) * (48 / 120.0::DOUBLE), k + 1.0) - greatest(i * (48 / 120.0::DOUBLE), k::DOUBLE) AS w FROM range(48) o(k), range(120) s(i) WHERE (i + 1) * (48 / 120.0::DOUBLE) > k AND i * (48 / 120.0::DOUBLE) < k + 1),
  b AS (SELECT k, i, least((i + 1) * (40 / 100.0::DOUBLE), k + 1.0) - greatest(i * (40 / 100.0::DOUBLE), k::DOUBLE) AS w FROM range(40) o(k), range(100) s(i) WHERE (i + 1) * (40 / 100.0::DOUBLE) > k AND i * (40 / 100.0::DOUBLE) < k + 1)
  SELECT a.k AS x, b.k AS y, round(sum(value * a.w * b.w) / sum(a.w * b.w), 6) AS value FROM p JOIN a ON a.i = p.x JOIN b ON b.i = p.y GROUP BY 1, 2""")
def region_area(spark, sf_dir):
    """A region at 0.4 times its size, by area."""
    return RS.region_area(V.mosaic(spark, sf_dir), 16, 24, 120, 100, 48, 40).withColumn("value", F.round("value", 6))


def _taps_sql(size: int, out: int) -> str:
    return f"SELECT o, greatest(0, least({size - 1}, (b + d)::BIGINT)) AS i, CASE d WHEN 0 THEN 1 - (pos - b) ELSE pos - b END AS w FROM (SELECT o, pos, floor(pos) AS b FROM (SELECT o, (o + 0.5::DOUBLE) * ({size}::DOUBLE / {out}) - 0.5::DOUBLE AS pos FROM range({out}) t(o))), range(2) k(d)"


@query(M + f""", p AS (SELECT x - 50 AS x, y - 40 AS y, value FROM mosaic WHERE x BETWEEN 50 AND 89 AND y BETWEEN 40 AND 69), a AS ({_taps_sql(40, 100)}), b AS ({_taps_sql(30, 75)})
  SELECT a.o AS x, b.o AS y, round(sum(value * a.w * b.w), 6) AS value FROM p JOIN a ON a.i = p.x JOIN b ON b.i = p.y GROUP BY 1, 2""")
def region_bilinear(spark, sf_dir):
    """A region at 2.5 times its size."""
    return RS.region_interpolated(V.mosaic(spark, sf_dir), 50, 40, 40, 30, 100, 75).withColumn("value", F.round("value", 6))


@query("""SELECT p_partkey, u AS unit, round(CASE u WHEN 'base_pixels' THEN 1.0 WHEN 'fraction' THEN 4000.0 WHEN 'mag_pixels' THEN 20.0 / (p_size % 4 * 5 + 5) WHEN 'nm' THEN 1 / 250.0 WHEN 'um' THEN 1 / 0.25 WHEN 'mm' THEN 1 / 0.00025 WHEN 'm' THEN 1 / 0.00000025 ELSE 1 / 0.00000000025 END::DOUBLE, 6) AS scale
  FROM part, (SELECT unnest(['base_pixels', 'fraction', 'mag_pixels', 'nm', 'um', 'mm', 'm', 'km']) AS u)""")
def scale_from_units(spark, sf_dir):
    """Base pixels for one unit, of an image 4000 wide at 20x and 0.25 micrometres a pixel."""
    p = V.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*[F.lit(u) for u in T.UNITS])).alias("unit"))
    scale = T.scale_from_units(F.col("unit"), F.lit(4000.0), F.lit(0.00025), F.lit(20.0), F.col("p_size") % 4 * 5 + 5.0)
    return p.select("p_partkey", "unit", F.round(scale, 6).alias("scale"))


@query("SELECT k, k % 5 AS x, k % 3 AS y, k % 4 AS z, k % 6 AS frame, k % 4 BETWEEN 0 AND 2 AND k % 6 < 4 AND k % 5 < ceil(300.0 / (64 * pow(2, 2 - k % 4))) AND k % 3 < ceil(200.0 / (64 * pow(2, 2 - k % 4))) AS valid FROM range(360) t(k)")
def tile_in_range(spark, sf_dir):
    """Whether a tile of a level and frame is there."""
    k = F.col("id")
    ok = T.tile_in_range(k % 5, k % 3, k % 4, k % 6, levels=3, tile_w=64, tile_h=64, size_x=300, size_y=200, frames=4)
    return spark.range(360).select(k.alias("k"), (k % 5).alias("x"), (k % 3).alias("y"), (k % 4).alias("z"), (k % 6).alias("frame"), ok.alias("valid"))


@query("""SELECT p_partkey, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y, lon AS back_lon, lat AS back_lat
  FROM (SELECT p_partkey, (p_partkey % 360 - 180)::DOUBLE AS lon, (p_size * 3 - 75)::DOUBLE AS lat FROM part)""")
def mercator(spark, sf_dir):
    """To the spherical Mercator projection and back."""
    lon, lat = (F.col("p_partkey") % 360 - 180).cast("double"), (F.col("p_size") * 3 - 75).cast("double")
    x, y = G.to_mercator(lon, lat)
    p = V.table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    a, b = G.from_mercator(F.col("x"), F.col("y"))
    return p.select("p_partkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(a, 6).alias("back_lon"), F.round(b, 6).alias("back_lat"))


GEO = (500000.0, 30.0, -2.5, 4100000.0, 1.5, -30.0)


@query("SELECT p_partkey, (p_partkey % 100)::BIGINT AS col, p_size::BIGINT AS row FROM part")
def projection_to_pixel(spark, sf_dir):
    """Map coordinates of an affine picture back to whole pixels."""
    px, py = G.affine(GEO, F.col("p_partkey") % 100 + 0.25, F.col("p_size") - 0.25)
    col, row = G.affine_inverse(GEO, px, py, whole=True)
    return V.table(spark, sf_dir, "part").select("p_partkey", col.alias("col"), row.alias("row"))


@query("SELECT k, z, round(x * s - 20037508.342789244, 4) AS xmin, round((x + 1) * s - 20037508.342789244, 4) AS xmax, round(20037508.342789244 - (y + 1) * s, 4) AS ymin, round(20037508.342789244 - y * s, 4) AS ymax FROM (SELECT k, k % 6 AS z, k // 6 % 4 AS x, k // 24 AS y, 40075016.685578488::DOUBLE / pow(2, k % 6) AS s FROM range(96) t(k))")
def tile_extents(spark, sf_dir):
    """Projected boxes of tiles of a Mercator world."""
    k = F.col("id")
    e = G.tile_extent(k % 6, F.expr("id div 6") % 4, F.expr("id div 24"))
    return spark.range(96).select(k.alias("k"), (k % 6).alias("z"), *[F.round(c, 4).alias(n) for n, c in e.items()])


STYLE = {"bands": [{"band": "r", "palette": ["#000", "#f00"], "min": 80, "max": 180}, {"band": "g", "palette": "green", "min": 100, "max": 150, "clamp": False}, {"band": "b", "palette": ["#00000000", "#0000ffff"], "nodata": 127, "min": "auto", "max": "auto"}]}


@query(_W3 + """, t AS (SELECT x, y, greatest(0.0, least(1.0, (r - 80) / 100.0::DOUBLE)) AS r, (g - 100) / 50.0::DOUBLE AS g, b, greatest(0.0, least(1.0, b / 255.0::DOUBLE)) AS v FROM w)
  SELECT x, y, floor(r * 255)::INT AS r, CASE WHEN g >= 0 AND g <= 1 THEN floor(g * 255)::INT ELSE 0 END AS g, CASE WHEN b <> 127 THEN floor(v * 255)::INT ELSE 0 END AS b, 255 AS a FROM t""")
def style_document(spark, sf_dir):
    """Three bands shaded and laid over one another as a document says."""
    return _wide(spark, sf_dir).select("x", "y", *[c.alias(n) for n, c in D.rgba(STYLE).items()])


EL = V.with_views("element")


def _renewed(spark, sf_dir):
    """Elements, and new ones for every seventh annotation."""
    e = V.element(spark, sf_dir).select("annotation", "id", "type", "version")
    new = e.where("annotation % 7 = 0 AND id % 2 = 0").select("annotation", (F.col("id") + 1000000).alias("id"), "type")
    return e, new


@query(EL + ", e AS (SELECT annotation, id, type, version FROM element), n AS (SELECT annotation, id + 1000000 AS id, type, 1000::BIGINT AS version FROM e WHERE annotation % 7 = 0 AND id % 2 = 0) SELECT * FROM e WHERE annotation NOT IN (SELECT annotation FROM n) UNION ALL SELECT * FROM n")
def elements_updated(spark, sf_dir):
    """The element table after an update of some annotations."""
    e, new = _renewed(spark, sf_dir)
    added, removed = ST.update_elements(e, new, F.lit(1000))
    return ST.after_update(e, added, removed, ["annotation", "id"])


@query(EL + "SELECT annotation, id FROM element WHERE NOT (type = 'circle' AND width > 20)")
def elements_removed(spark, sf_dir):
    return ST.remove_where(V.element(spark, sf_dir), (F.col("type") == "circle") & (F.col("width") > 20)).select("annotation", "id")


HI = V.with_views("history")


@query(HI + "SELECT annotation, version, kind FROM history UNION ALL SELECT annotation, max(version) + 1, 'saved' FROM history WHERE annotation % 3 = 0 GROUP BY annotation")
def annotation_saved(spark, sf_dir):
    """The history with a new version of some annotations."""
    h = V.history(spark, sf_dir).select("annotation", "version", "kind")
    changed = h.where("annotation % 3 = 0").select("annotation").distinct().withColumn("kind", F.lit("saved"))
    return ST.save_version(h, changed)


@query(HI + "SELECT annotation, version, active AND annotation % 5 <> 0 AS active FROM history")
def annotations_removed(spark, sf_dir):
    """Removed annotations stay as inactive rows."""
    h = V.history(spark, sf_dir).select("annotation", "version", "active")
    return ST.remove_annotations(h, h.where("annotation % 5 = 0"))


@query(V.with_views("item", "element") + "SELECT i.item + 100000 AS item, e.id AS origin, e.type FROM element e JOIN item i ON i.item = e.annotation WHERE i.item % 10 = 0")
def annotations_copied(spark, sf_dir):
    """Annotations of some items on other items."""
    a = V.element(spark, sf_dir).select(F.col("annotation").alias("item"), F.col("id").alias("annotation"), "type")
    pairs = V.item(spark, sf_dir).where("item % 10 = 0").select("item", (F.col("item") + 100000).alias("target"))
    return ST.copy_annotations(a, pairs)


@query("SELECT o_orderkey, greatest(CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE -1 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END) AS level FROM orders")
def access_levels(spark, sf_dir):
    """What user 0 of group 0 may do with each annotation: by their own entry, their group's, or as the public."""
    entry = lambda kind, i, level: F.struct(F.lit(kind).alias("kind"), i.alias("id"), F.lit(level).alias("level"))
    access = F.array(entry("user", F.col("o_custkey") % 4, ST.ADMIN), entry("group", F.col("o_orderkey") % 3, ST.WRITE))
    zero = F.lit(0).cast("long")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", ST.level_of(access, zero, F.array(zero), F.col("o_orderstatus") == "O").alias("level"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_filter(['user:' || (o_custkey % 4) || ':' || CASE WHEN o_custkey % 4 = 1 THEN 0 ELSE 2 END, CASE WHEN o_orderkey % 3 <> 2 THEN 'group:' || (o_orderkey % 3) || ':1' END], lambda x: x IS NOT NULL)), '|') AS entries FROM orders")
def access_changed(spark, sf_dir):
    """Access lists after an entry is lowered and another removed."""
    entry = lambda kind, i, level: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("id"), level.cast("int").alias("level"))
    access = F.array(entry("user", F.col("o_custkey") % 4, F.lit(2)), entry("group", F.col("o_orderkey") % 3, F.lit(1)))
    own = F.when(F.col("o_custkey") % 4 == 1, 1).otherwise(-1)
    changes = F.filter(F.array(entry("user", own, F.lit(0)), entry("group", F.lit(2), F.lit(None))), lambda c: c["id"] >= 0)
    text = F.transform(ST.set_access(access, changes), lambda a: F.concat_ws(":", a["kind"], a["id"].cast("string"), a["level"].cast("string")))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(text), "|").alias("entries"))


@query(M + ", m AS (SELECT x, y FROM mosaic WHERE value > 130 AND x < 192 AND y < 160) SELECT (x // 32)::BIGINT AS tx, (y // 32)::BIGINT AS ty, count(*)::BIGINT AS above FROM m GROUP BY 1, 2 HAVING count(*) > 0.35 * 1024")
def mask_batches(spark, sf_dir):
    """Tiles of which more than a third lies under the mask."""
    m = V.mosaic(spark, sf_dir).select("x", "y", (F.col("value") > 130).cast("int").alias("value"))
    grid = T.tile_grid(spark, T.Axis(192, 32), T.Axis(160, 32))
    kept = B.keep_by_mask(grid, m, 0.35)
    under = m.where("value > 0").groupBy(F.expr("x div 32").alias("level_x"), F.expr("y div 32").alias("level_y")).agg(F.count("*").alias("above"))
    return kept.join(under, ["level_x", "level_y"]).select(F.col("level_x").alias("tx"), F.col("level_y").alias("ty"), "above")


@query("""WITH t AS (SELECT i AS level_x, j AS level_y, i * 64 AS x, j * 64 AS y, least(64, 500 - i * 64) AS width, least(64, 400 - j * 64) AS height FROM range(8) a(i), range(7) b(j) WHERE (i * 7 + j * 3) % 5 <> 0)
  SELECT level_x // 3 AS chunk_x, level_y // 2 AS chunk_y, count(*)::BIGINT AS tiles, min(x)::BIGINT AS lft, min(y)::BIGINT AS top, max(x + width)::BIGINT AS rgt, max(y + height)::BIGINT AS bottom, count(*) = 6 AS whole FROM t GROUP BY 1, 2""")
def incomplete_chunks(spark, sf_dir):
    """Reads of an incomplete grid in blocks of three by two."""
    g = T.tile_grid(spark, T.Axis(500, 64), T.Axis(400, 64)).where((F.col("level_x") * 7 + F.col("level_y") * 3) % 5 != 0)
    c = B.grid_chunks(g, 3, 2)
    return c.select("chunk_x", "chunk_y", "tiles", F.col("left").cast("long").alias("lft"), F.col("top").cast("long").alias("top"), F.col("right").cast("long").alias("rgt"), F.col("bottom").cast("long").alias("bottom"), "whole")


@query(EL + """, a AS (SELECT id, cx, cy, row_number() OVER (ORDER BY cx, id) - 1 AS p, count(*) OVER () AS n FROM element), b AS (SELECT *, (p * 2 >= n)::BIGINT AS h FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cy, id) - 1 AS q, count(*) OVER (PARTITION BY h) AS m FROM b) SELECT id, (h * 2 + (q * 2 >= m)::BIGINT)::BIGINT AS chunk FROM c""")
def kd_chunks(spark, sf_dir):
    """Scattered regions in four chunks by halves along x and y."""
    e = V.element(spark, sf_dir).select("id", "cx", "cy")
    return B.kd_chunks(e, 2, "cx", "cy", "id").select("id", "chunk")


@query("SELECT i * 48 AS x, j * 48 AS y, greatest(i * 48 + 64 - 200, 0) AS pad_right, greatest(j * 48 + 64 - 150, 0) AS pad_bottom FROM range(4) a(i), range(3) b(j)")
def edge_padding(spark, sf_dir):
    """The padding of windows that cross the border."""
    w = spark.range(12).select((F.col("id") % 4 * 48).alias("x"), (F.expr("id div 4") * 48).alias("y"))
    return B.edge_cases(w, 200, 150, 64, 64).select("x", "y", "pad_right", "pad_bottom")


_KINDS = "['point', 'multipoint', 'polyline', 'multipolyline', 'polygon', 'multipolygon', 'circle', 'ellipse', 'rectangle'][id % 9 + 1]"


@query(EL + f", e AS (SELECT id, cx, cy, width, height, {_KINDS} AS kind FROM element) SELECT id, CASE kind WHEN 'multipoint' THEN 'point' WHEN 'multipolyline' THEN 'polyline' WHEN 'polygon' THEN 'polyline' WHEN 'multipolygon' THEN 'polyline' ELSE kind END AS type, k AS part, kind IN ('polygon', 'multipolygon') AS closed, (CASE WHEN kind IN ('point', 'multipoint', 'circle', 'ellipse', 'rectangle') THEN 1 WHEN kind IN ('polygon', 'multipolygon') THEN 4 ELSE 3 END)::INT AS points, round(CASE WHEN kind IN ('point', 'multipoint', 'circle', 'ellipse', 'rectangle') THEN cx + k * 100 ELSE cx + k * 100 - width / 2 END, 6) AS x, round(CASE WHEN kind IN ('point', 'multipoint', 'circle', 'ellipse', 'rectangle') THEN cy ELSE cy - height / 2 END, 6) AS y FROM e, range(2) t(k) WHERE k = 0 OR kind IN ('multipoint', 'multipolyline', 'multipolygon')")
def geojson_elements(spark, sf_dir):
    """Features of every geometry read as elements: one for each part of a multiple geometry."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("point", "multipoint", "polyline", "multipolyline", "polygon", "multipolygon", "circle", "ellipse", "rectangle")]), (F.col("id") % 9 + 1).cast("int"))
    e = V.element(spark, sf_dir).select("id", J.sample_feature(kind).alias("json"))
    rows = e.select("id", F.posexplode(J.elements(F.col("json"))).alias("part", "e"))
    return rows.select("id", "e.type", F.col("part").cast("long").alias("part"), F.coalesce("e.closed", F.lit(False)).alias("closed"), F.size("e.points").alias("points"), F.round(F.col("e.points")[0]["x"], 6).alias("x"), F.round(F.col("e.points")[0]["y"], 6).alias("y"))
