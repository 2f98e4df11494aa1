"""Queries of colours, padding, mergers, keys and file patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import colours as K
from tilewright.operators import raster as R
from tilewright.plans.registry import query
from tilewright.sources import tiles_source
from tilewright.sources import views as V


def _part(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "part")


HEX = "lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0'))"


@query(f"SELECT p_partkey, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b, 255 AS a FROM (SELECT p_partkey, {HEX} AS h FROM part)")
def palette_colors(spark, sf_dir):
    text = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    c = _part(spark, sf_dir).select("p_partkey", K.channels(text).alias("c"))
    return c.select("p_partkey", *[F.col("c")[k].alias(n) for k, n in enumerate("rgba")])


@query("SELECT p_partkey, p_partkey % 4 < 2 AS valid FROM part")
def valid_colors(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "#a1B2c3").when(k % 4 == 1, "rgba(1, 2, 3, 0.5)").when(k % 4 == 2, "#12").otherwise("red; drop")
    return _part(spark, sf_dir).select("p_partkey", K.is_colour(text).alias("valid"))


@query("WITH p AS (SELECT DISTINCT p_brand AS name, TRY_CAST(split_part(p_brand, '#', 2) AS INT) AS n FROM part) SELECT a.name FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.n = a.n + 1)")
def reduced_palettes(spark, sf_dir):
    """Names whose next larger variant isn't there."""
    p = _part(spark, sf_dir).select(F.col("p_brand").alias("name")).distinct().withColumn("n", F.expr("try_cast(split_part(name, '#', 2) AS int)"))
    return p.join(p.select((F.col("n") - 1).alias("n")), "n", "left_anti").select("name")


@query(V.with_views("mosaic") + "SELECT x, y, floor(value * ((x % 256) / 255.0::DOUBLE) + (1 - (x % 256) / 255.0::DOUBLE) * 240)::INT AS value FROM mosaic")
def rgba_to_rgb(spark, sf_dir):
    return V.mosaic(spark, sf_dir).select("x", "y", K.over_background(F.col("value"), F.col("x") % 256, F.lit(240)).alias("value"))


@query("SELECT p_partkey, floor(greatest(64 - p_size, 0) / 2.0)::BIGINT AS before, ceil(greatest(64 - p_size, 0) / 2.0)::BIGINT AS after FROM part")
def pad_equal(spark, sf_dir):
    a, b = K.equal_padding(F.col("p_size"), F.lit(64))
    return _part(spark, sf_dir).select("p_partkey", a.alias("before"), b.alias("after"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 90 < p_partkey % 70 THEN greatest(40 - p_size, 0) ELSE 0 END::BIGINT AS before, CASE WHEN p_partkey % 90 < p_partkey % 70 THEN 0 ELSE greatest(40 - p_size, 0) END::BIGINT AS after FROM part")
def pad_edge(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = K.edge_padding(F.col("p_size"), F.lit(40), k % 90, k % 70)
    return _part(spark, sf_dir).select("p_partkey", a.alias("before"), b.alias("after"))


@query(V.with_views("mosaic") + ", t AS (SELECT x // 32 AS tx, y // 32 AS ty, floor(avg(value))::INT AS fill, max(value) AS top, count(*)::BIGINT AS n FROM mosaic GROUP BY 1, 2) SELECT tx, ty, fill, top, 1024 - n AS padded FROM t")
def constant_color(spark, sf_dir):
    """Mean and highest fill colours of tiles, and the pixels they have to fill."""
    t = V.mosaic(spark, sf_dir).groupBy(F.expr("x div 32").alias("tx"), F.expr("y div 32").alias("ty"))
    return t.agg(F.floor(F.avg("value")).cast("int").alias("fill"), F.max("value").alias("top"), F.count("*").alias("n")).select("tx", "ty", "fill", "top", (1024 - F.col("n")).alias("padded"))


@query(V.with_views("mosaic") + ", z AS (SELECT " + V.HEIGHT_SQL + " AS h), g AS (SELECT unnest(range(greatest(h, 200) + 20)) AS x, h FROM z), k AS (SELECT x, h, unnest(range(greatest(h, 200) + 20)) AS y FROM g) SELECT k.x, k.y, coalesce(m.value, 255) AS value FROM k LEFT JOIN mosaic m ON m.x = k.x - (greatest(h, 200) + 20 - 200) // 2 AND m.y = k.y - (greatest(h, 200) + 20 - h) // 2")
def letterbox(spark, sf_dir):
    """The raster in the middle of a square, the rest filled."""
    h = V.height(spark, sf_dir)
    side = max(h, V.WIDTH) + 20
    return R.on_canvas(V.mosaic(spark, sf_dir), V.WIDTH, h, side, side, (side - V.WIDTH) // 2, (side - h) // 2, 255)


@query("SELECT event_id, md5(concat_ws('|', event_type, 'k=' || user_id::VARCHAR, 'w=256')) AS key FROM events")
def cache_keys(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", K.cache_key(F.col("event_type"), w=F.lit(256), k=F.col("user_id")).alias("key"))


@query("SELECT user_id % 10 AS band, least(min(value), 0.0) AS low, greatest(max(value), 0.0) AS high FROM events GROUP BY 1")
def band_ranges(spark, sf_dir):
    """Ranges of bands that some tiles lack: those count as zero."""
    e = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("band"))
    return e.agg(F.least(F.min("value"), F.lit(0.0)).alias("low"), F.greatest(F.max("value"), F.lit(0.0)).alias("high"))


@query("SELECT k, round(10.0::DOUBLE + (90.0::DOUBLE - 10.0::DOUBLE) * k / 6, 9) AS stop FROM range(7) t(k)")
def interpolate_minmax(spark, sf_dir):
    return spark.range(7).select(F.col("id").alias("k"), F.round(10.0 + 80.0 * F.col("id") / 6, 9).alias("stop"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_orderkey % 3 * 2.5 + o_orderkey % 11 * 0.5 END::DOUBLE AS z FROM orders")
def axis_values(spark, sf_dir):
    """The value of a frame on an axis: set outright, or from a start and a step."""
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, F.lit(5.0)).otherwise(k % 3 * 2.5 + k % 11 * 0.5).alias("z"))


PATHS = "SELECT p_partkey, 'img' || p_partkey % 7 || '_files/' || p_partkey % 12 || '/' || p_partkey % 31 || '_' || p_partkey % 17 || CASE WHEN p_partkey % 5 = 0 THEN '.txt.bak' ELSE '.jpeg' END AS path FROM part"


@query(f"SELECT p_partkey, 'img' || p_partkey % 7 AS image, (p_partkey % 12)::INT AS level, (p_partkey % 31)::INT AS tx, (p_partkey % 17)::INT AS ty FROM ({PATHS}) WHERE p_partkey % 5 > 0")
def deepzoom_paths(spark, sf_dir):
    """Tile coordinates in the paths of a Deep Zoom folder."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("img"), (k % 7).cast("string"), F.lit("_files/"), (k % 12).cast("string"), F.lit("/"), (k % 31).cast("string"), F.lit("_"), (k % 17).cast("string"), F.when(k % 5 == 0, ".txt.bak").otherwise(".jpeg"))
    p = _part(spark, sf_dir).select(k, path.alias("path")).where(F.col("path").rlike(tiles_source.DEEP_ZOOM))
    c = tiles_source.deep_zoom_parts(F.col("path"))
    return p.select("p_partkey", *[c[n].alias(n) for n in ("image", "level", "tx", "ty")])


@query("SELECT p_partkey, (p_partkey % 9 + 1 - 1)::INT AS c, (p_partkey % 4)::INT AS z, row_number() OVER (ORDER BY 'C' || p_partkey % 9 + 1 || '_Z' || p_partkey % 4, p_partkey)::BIGINT AS place FROM part".replace("'C' || p_partkey % 9 + 1 || '_Z' || p_partkey % 4", "'C' || (p_partkey % 9 + 1)::VARCHAR || '_Z' || (p_partkey % 4)::VARCHAR"))
def path_patterns(spark, sf_dir):
    """Axis numbers from file names by a pattern, one of them counted from one; files in order.
    The order is over a folder's listing, which is small beside its pixels."""
    k = F.col("p_partkey")
    p = _part(spark, sf_dir).select(k, F.format_string("C%d_Z%d", k % 9 + 1, k % 4).alias("file"))
    number = lambda g: F.regexp_extract("file", r"C(\d+)_Z(\d+)", g).cast("int")
    return p.select("p_partkey", (number(1) - 1).alias("c"), number(2).alias("z"), F.row_number().over(Window.orderBy("file", "p_partkey")).cast("long").alias("place"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE event_type = 'click') WHERE k > 3")
def thumbnails_to_remove(spark, sf_dir):
    """All cached files of an item but the three newest."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    e = V.table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.withColumn("k", F.row_number().over(w)).where("k > 3").select("user_id", "event_id")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE regexp_matches(props, '\"k\": ?[0-4]') GROUP BY 1")
def cached_by_pattern(spark, sf_dir):
    return V.table(spark, sf_dir, "events").where(F.col("props").rlike('"k": ?[0-4]')).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'self' WHEN event_id % 3 = 1 THEN 'parent' ELSE 'root' END AS source, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 1 THEN user_id % 10 ELSE 0 END::BIGINT AS setting FROM events")
def config_inheritance(spark, sf_dir):
    """A setting from the nearest folder that has it."""
    k, u = F.col("event_id"), F.col("user_id")
    own, parent = F.when(k % 3 == 0, u), F.when(k % 3 <= 1, u % 10)
    return V.table(spark, sf_dir, "events").select(k, F.when(own.isNotNull(), "self").when(parent.isNotNull(), "parent").otherwise("root").alias("source"), F.coalesce(own, parent, F.lit(0)).cast("long").alias("setting"))


@query("SELECT event_id, i AS row, (i * 10 + event_id % 3)::BIGINT AS value FROM events, range(3) t(i) WHERE i < event_id % 4")
def nested_rows(spark, sf_dir):
    """Lists in documents as rows with their position."""
    k = F.col("event_id")
    rows = F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: i * 10 + k % 3)
    e = V.table(spark, sf_dir, "events").select(k, F.posexplode(F.slice(rows, 1, (k % 4).cast("int"))).alias("row", "value"))
    return e.select("event_id", F.col("row").cast("long").alias("row"), F.col("value").cast("long").alias("value"))


@query("SELECT o_custkey AS annotation, count(*)::BIGINT AS n, count(DISTINCT o_orderkey % 97)::BIGINT AS n_ids, count(*) = count(DISTINCT o_orderkey % 97) AS valid FROM orders GROUP BY 1")
def unique_element_ids(spark, sf_dir):
    """Whether the element ids of an annotation are distinct."""
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("annotation"))
    return o.agg(F.count("*").alias("n"), F.countDistinct(F.col("o_orderkey") % 97).alias("n_ids")).withColumn("valid", F.col("n") == F.col("n_ids"))


@query(V.with_views("element") + ", a AS (SELECT id, annotation, cos(id % 5 * 0.3::DOUBLE) AS c, sin(id % 5 * 0.3::DOUBLE) AS s, cx, cy, width FROM element) SELECT id, round(cx + width * c, 6) AS x, round(cy + width * s, 6) AS y FROM a")
def rotate_points(spark, sf_dir):
    """A corner turned about its element's centre."""
    t = F.col("id") % 5 * 0.3
    return V.element(spark, sf_dir).select("id", F.round(F.col("cx") + F.col("width") * F.cos(t), 6).alias("x"), F.round(F.col("cy") + F.col("width") * F.sin(t), 6).alias("y"))


@query("SELECT kind, high, CASE kind WHEN 'uint8' THEN 255.0 WHEN 'uint16' THEN 65535.0 ELSE CASE WHEN high <= 1 THEN 1.0 WHEN high < 256 THEN 255.0 ELSE 65535.0 END END::DOUBLE AS alpha FROM (SELECT CASE WHEN k % 3 = 0 THEN 'uint8' WHEN k % 3 = 1 THEN 'uint16' ELSE 'float' END AS kind, k * k / 2.0::DOUBLE AS high FROM range(60) t(k))")
def full_alpha(spark, sf_dir):
    k = F.col("id")
    d = spark.range(60).select(F.when(k % 3 == 0, "uint8").when(k % 3 == 1, "uint16").otherwise("float").alias("kind"), (k * k / 2.0).alias("high"))
    return d.withColumn("alpha", K.opaque(F.col("kind"), F.col("high")))


@query("""WITH s AS (SELECT 0 AS src, f, f % 3 AS c, f // 3 AS z FROM range(6) t(f) UNION ALL SELECT 1, f, f % 2, 2 + f // 2 FROM range(4) t(f)) SELECT c, z, count(*)::BIGINT AS sources, min(src * 100 + f)::BIGINT AS first FROM s GROUP BY c, z""")
def union_frames(spark, sf_dir):
    """The frames of two sources on common axes."""
    a = spark.range(6).select(F.lit(0).alias("src"), F.col("id").alias("f"), (F.col("id") % 3).alias("c"), F.expr("id div 3").alias("z"))
    b = spark.range(4).select(F.lit(1).alias("src"), F.col("id").alias("f"), (F.col("id") % 2).alias("c"), (2 + F.expr("id div 2")).alias("z"))
    return a.unionByName(b).groupBy("c", "z").agg(F.count("*").alias("sources"), F.min(F.col("src") * 100 + F.col("f")).alias("first"))


@query("SELECT s.level, s.tx, s.ty, least(64, ceil(300 / s.scale)::BIGINT - s.tx * 64)::INT AS width FROM (SELECT l AS level, pow(2, 3 - l)::BIGINT AS scale, x AS tx, y AS ty FROM range(4) a(l), range(5) b(x), range(4) c(y)) s WHERE s.tx * 64 < ceil(300.0 / scale) AND s.ty * 64 < ceil(200.0 / scale)".replace("ceil(300 / s.scale)", "ceil(300.0 / s.scale)"))
def synthetic_tiles(spark, sf_dir):
    """Tiles of all levels of a synthetic image, from a Spark data source."""
    from tilewright.session import ship

    ship(spark)
    spark.dataSource.register(tiles_source.SyntheticTiles)
    t = spark.read.format("synthetic_tiles").options(sizeX=300, sizeY=200, tile=64).load()
    return t.select(F.col("level").cast("long").alias("level"), F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "width")
