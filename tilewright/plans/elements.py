"""Queries of drawn elements and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import elements as E
from tilewright.plans.registry import query
from tilewright.sources import views as V

EL = V.with_views("element")
BOX = EL + """, turned AS (SELECT *, CASE WHEN type = 'rectangle' THEN (id % 8) * 0.25::DOUBLE ELSE 0.0 END AS rotation FROM element),
half AS (SELECT *, CASE type WHEN 'rectangle' THEN CASE WHEN rotation = 0 THEN width * 0.5 ELSE greatest(abs(cos(rotation)) * width * 0.5, abs(sin(rotation)) * height * 0.5) END WHEN 'circle' THEN width * 0.5 ELSE 0.5 END AS hw,
  CASE type WHEN 'rectangle' THEN CASE WHEN rotation = 0 THEN height * 0.5 ELSE greatest(abs(sin(rotation)) * width * 0.5, abs(cos(rotation)) * height * 0.5) END WHEN 'circle' THEN width * 0.5 ELSE 0.5 END AS hh FROM turned),
box AS (SELECT *, cx - hw AS lowx, cy - hh AS lowy, cx + hw AS highx, cy + hh AS highy, CASE WHEN type = 'point' THEN 1 ELSE 4 END AS details, sqrt(pow(cy + hh - (cy - hh), 2) + pow(cx + hw - (cx - hw), 2)) AS size FROM half)
"""
REGION = "highx >= 3000 AND lowx < 4000 AND highy >= 4500 AND lowy < 6500"


def _boxes(spark, sf_dir) -> DataFrame:
    e = V.element(spark, sf_dir)
    return E.bounding_box(e.withColumn("rotation", F.when(F.col("type") == "rectangle", F.col("id") % 8 * 0.25).otherwise(0.0)))


@query(BOX + "SELECT id, round(lowx, 6) AS lowx, round(lowy, 6) AS lowy, round(highx, 6) AS highx, round(highy, 6) AS highy, round(size, 6) AS size, details FROM box")
def element_bbox(spark, sf_dir):
    return _boxes(spark, sf_dir).select("id", *[F.round(c, 6).alias(c) for c in ("lowx", "lowy", "highx", "highy", "size")], "details")


@query(EL + """, p AS (SELECT annotation, list({'x': cx, 'y': cy} ORDER BY id) AS points FROM element GROUP BY annotation)
  SELECT annotation, list_min(list_transform(points, lambda q: q.x)) AS lowx, list_min(list_transform(points, lambda q: q.y)) AS lowy, list_max(list_transform(points, lambda q: q.x)) AS highx, list_max(list_transform(points, lambda q: q.y)) AS highy, len(points)::INT AS details FROM p""")
def element_bbox_polyline(spark, sf_dir):
    e = V.element(spark, sf_dir)
    lines = e.groupBy("annotation").agg(F.sort_array(F.collect_list(F.struct("id", F.col("cx").alias("x"), F.col("cy").alias("y")))).alias("points"))
    none = F.lit(None).cast("double")
    lines = lines.withColumns({"type": F.lit("polyline"), "cx": none, "cy": none, "width": none, "height": none})
    return E.bounding_box(lines).select("annotation", "lowx", "lowy", "highx", "highy", "details")


@query(BOX + f"SELECT id, type FROM box WHERE {REGION}")
def elements_region(spark, sf_dir):
    return _boxes(spark, sf_dir).where(E.in_region(3000, 4000, 4500, 6500)).select("id", "type")


@query(BOX + f"SELECT id, type FROM box WHERE {REGION} AND size >= 40")
def elements_minsize(spark, sf_dir):
    return _boxes(spark, sf_dir).where(E.in_region(3000, 4000, 4500, 6500, 40)).select("id", "type")


@query(BOX + "SELECT id FROM box WHERE lowx < 2000 AND highy >= 100")
def elements_open_region(spark, sf_dir):
    """A left bound of zero is no bound."""
    return _boxes(spark, sf_dir).where(E.in_region(left=0, right=2000, top=100)).select("id")


@query(BOX + "SELECT id, round(size, 6) AS size FROM box ORDER BY round(box.size, 6) DESC, id LIMIT 50 OFFSET 100")
def elements_page(spark, sf_dir):
    return _boxes(spark, sf_dir).orderBy(F.round("size", 6).desc(), "id").offset(100).limit(50).select("id", F.round("size", 6).alias("size"))


@query(BOX + "SELECT id, details FROM box ORDER BY details DESC, created, id LIMIT 100")
def elements_sort(spark, sf_dir):
    return _boxes(spark, sf_dir).orderBy(F.col("details").desc(), "created", "id").limit(100).select("id", "details")


def _budget_sql(most: int, least: int) -> str:
    return BOX + f", r AS (SELECT id, details, coalesce(sum(details) OVER (ORDER BY round(size, 6) DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, row_number() OVER (ORDER BY round(size, 6) DESC, id) AS k FROM box) SELECT id, details FROM r WHERE (prior < {most} OR k <= {least}) AND k <= {max(most, least)}"


@query(_budget_sql(300, 0))
def elements_maxdetails(spark, sf_dir):
    return E.within_budget(_boxes(spark, sf_dir), [F.round("size", 6).desc(), F.col("id")], 300).select("id", "details")


@query(_budget_sql(40, 25))
def elements_maxdetails_minelements(spark, sf_dir):
    return E.within_budget(_boxes(spark, sf_dir), [F.round("size", 6).desc(), F.col("id")], 40, 25).select("id", "details")


@query(BOX + ", g AS (SELECT grp, dense_rank() OVER (ORDER BY grp) - 1 AS code FROM (SELECT DISTINCT grp FROM box)) SELECT id, (lowx + highx) / 2 AS x, (lowy + highy) / 2 AS y, round(size, 6) AS size, code FROM box JOIN g USING (grp)")
def elements_centroids(spark, sf_dir):
    """Centres with their group as a code from a table of distinct groups."""
    from pyspark.sql import Window

    b = _boxes(spark, sf_dir)
    codes = b.select("grp").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("grp")) - 1).cast("long"))
    return b.join(codes, "grp").select("id", ((F.col("lowx") + F.col("highx")) / 2).alias("x"), ((F.col("lowy") + F.col("highy")) / 2).alias("y"), F.round("size", 6).alias("size"), "code")


@query(EL + "SELECT annotation, array_to_string(list_sort(list_distinct(list(CASE WHEN id % 9 > 0 THEN grp END))), '|') AS groups, bool_or(id % 9 = 0) AS has_null FROM element GROUP BY annotation")
def element_groups(spark, sf_dir):
    """Sorted distinct groups of each annotation, and whether an element has none."""
    e = V.element(spark, sf_dir).withColumn("g", F.when(F.col("id") % 9 > 0, F.col("grp")))
    return e.groupBy("annotation").agg(F.array_join(F.array_sort(F.collect_set("g")), "|").alias("groups"), F.bool_or(F.col("g").isNull()).alias("has_null"))


@query(EL + "SELECT annotation, count(*)::BIGINT AS n, sum(CASE WHEN type = 'point' THEN 1 ELSE 4 END)::BIGINT AS details FROM element GROUP BY annotation")
def element_counts(spark, sf_dir):
    e = V.element(spark, sf_dir)
    return e.groupBy("annotation").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "point", 1).otherwise(4)).alias("details"))


@query(BOX + "SELECT annotation, round(min(lowx), 6) AS lowx, round(min(lowy), 6) AS lowy, round(max(highx), 6) AS highx, round(max(highy), 6) AS highy FROM box GROUP BY annotation")
def element_bounds_union(spark, sf_dir):
    b = _boxes(spark, sf_dir).groupBy("annotation")
    return b.agg(F.round(F.min("lowx"), 6).alias("lowx"), F.round(F.min("lowy"), 6).alias("lowy"), F.round(F.max("highx"), 6).alias("highx"), F.round(F.max("highy"), 6).alias("highy"))


@query(EL + "SELECT annotation, id FROM element e WHERE version < (SELECT max(version) FROM element m WHERE m.annotation = e.annotation)")
def old_elements(spark, sf_dir):
    """Elements of versions before an annotation's last: those to remove."""
    e = V.element(spark, sf_dir)
    last = e.groupBy("annotation").agg(F.max("version").alias("last"))
    return e.join(last, "annotation").where("version < last").select("annotation", "id")


@query("SELECT (max(event_id) + 1)::BIGINT AS next_version FROM events")
def next_version(spark, sf_dir):
    return V.history(spark, sf_dir).agg((F.max("version") + 1).alias("next_version"))


HI = V.with_views("history")


@query(HI + "SELECT annotation, version, updated, active FROM (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY version DESC) AS k FROM history) WHERE k = 1")
def history_latest(spark, sf_dir):
    return E.latest(V.history(spark, sf_dir), ["annotation"], "version", ["updated", "active"]).select("annotation", "version", "updated", "active")


@query(HI + "SELECT annotation, version, kind FROM (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY version DESC) AS k FROM history) WHERE k = 2")
def history_previous(spark, sf_dir):
    return E.nth_version(V.history(spark, sf_dir), ["annotation"], "version", 2, ["kind"])


@query(HI + "SELECT version, any_value(kind) AS kind FROM history WHERE annotation = 7 GROUP BY version ORDER BY version DESC LIMIT 20 OFFSET 2")
def history_versions(spark, sf_dir):
    """One row a version of an annotation, newest first, paged."""
    h = V.history(spark, sf_dir).where("annotation = 7")
    return h.groupBy("version").agg(F.min("kind").alias("kind")).orderBy(F.col("version").desc()).offset(2).limit(20)


@query(HI + ", k AS (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY version DESC) AS k FROM history), a AS (SELECT annotation, bool_or(active) FILTER (k = 1) AS live FROM k GROUP BY annotation) SELECT k.annotation, k.version FROM k JOIN a USING (annotation) WHERE k.k = CASE WHEN live THEN 2 ELSE 1 END")
def history_revert(spark, sf_dir):
    """The version to go back to: the newest if the annotation is deleted, else the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("annotation").orderBy(F.col("version").desc())
    k = V.history(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 2")
    live = k.groupBy("annotation").agg(F.bool_or(F.when(F.col("k") == 1, F.col("active"))).alias("live"))
    return k.join(live, "annotation").where(F.col("k") == F.when(F.col("live"), 2).otherwise(1)).select("annotation", "version")


@query(EL + """, b AS (SELECT id, cx - width / 2 AS x0, cy - height / 2 AS y0, cx + width / 2 AS x1, cy + height / 2 AS y1 FROM element), f AS (SELECT id, x0 + id % 4 - 1 AS x0, y0 + id % 3 - 1 AS y0, x1 + id % 5 - 2 AS x1, y1 AS y1 FROM b)
  SELECT f.id AS file_row, b.id AS element FROM f JOIN b ON abs(f.x0 - b.x0) <= 2 AND abs(f.y0 - b.y0) <= 2 AND abs(f.x1 - b.x1) <= 2 AND abs(f.y1 - b.y1) <= 2""")
def bbox_band_join(spark, sf_dir):
    """File rows matched to elements whose four edges are within two pixels."""
    e = V.element(spark, sf_dir)
    b = e.select("id", (F.col("cx") - F.col("width") / 2).alias("x0"), (F.col("cy") - F.col("height") / 2).alias("y0"), (F.col("cx") + F.col("width") / 2).alias("x1"), (F.col("cy") + F.col("height") / 2).alias("y1"))
    f = b.select("id", (F.col("x0") + F.col("id") % 4 - 1).alias("x0"), (F.col("y0") + F.col("id") % 3 - 1).alias("y0"), (F.col("x1") + F.col("id") % 5 - 2).alias("x1"), "y1")
    return E.band_join(f, b).select(F.col("a_id").alias("file_row"), F.col("b_id").alias("element"))


@query(EL + """SELECT id, CASE type WHEN 'point' THEN 'Point' ELSE 'Polygon' END AS geometry, CASE type WHEN 'point' THEN 1 ELSE 5 END AS corners, round(CASE type WHEN 'point' THEN cx ELSE cx - width / 2 END, 6) AS x0, round(CASE type WHEN 'point' THEN cy ELSE cy - height / 2 END, 6) AS y0 FROM element""")
def geojson_out(spark, sf_dir):
    """Elements as GeoJSON geometries, told by their first corner."""
    from tilewright.functions.geojson import geometry

    g = V.element(spark, sf_dir).withColumn("g", geometry())
    ring = F.col("g.ring")
    return g.select("id", F.col("g.type").alias("geometry"), F.size(ring).alias("corners"), F.round(ring[0]["x"], 6).alias("x0"), F.round(ring[0]["y"], 6).alias("y0"))


@query(EL + "SELECT id, cx AS x, cy AS y, width, height FROM element WHERE type = 'rectangle'")
def geojson_in(spark, sf_dir):
    """Polygons of four corners read back as rectangles."""
    from tilewright.functions.geojson import feature, rectangle

    j = V.element(spark, sf_dir).where("type = 'rectangle'").select("id", feature().alias("json"))
    return j.select("id", rectangle(F.col("json")).alias("r")).select("id", *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("x", "y", "width", "height")])


@query("SELECT k, 5.0 + 2.5 * (k % 30) AS x, 7.0 + 1.5 * (k // 30) AS y, (k * 37 % 101) / 100.0::DOUBLE AS value FROM range(600) t(k)")
def grid_to_points(spark, sf_dir):
    """Values on a grid 30 wide as points."""
    return spark.range(600).select(F.col("id").alias("k"), (5.0 + 2.5 * (F.col("id") % 30)).alias("x"), (7.0 + 1.5 * F.expr("id div 30")).alias("y"), (F.col("id") * 37 % 101 / 100.0).alias("value"))


@query("WITH g AS (SELECT user_id % 20 AS grid, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT grid, k AS stop, round(lo + (hi - lo) * k / 4.0::DOUBLE, 9) AS at FROM g, range(5) t(k)")
def heatmap_color_table(spark, sf_dir):
    """Five equal colour stops over the values of each grid."""
    g = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("grid")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("grid", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("stop")).select("grid", "stop", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("stop") / 4.0, 9).alias("at"))


@query("SELECT user_id % 20 AS grid, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1")
def grid_contour_range(spark, sf_dir):
    return V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("grid")).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
