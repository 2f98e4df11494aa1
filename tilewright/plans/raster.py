"""Queries of pixel statistics, pyramids, regions, styles and compositing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import style as S
from tilewright.operators import raster as R
from tilewright.plans.registry import query
from tilewright.sources import views as V

M = V.with_views("mosaic")
M3 = V.with_views("mosaic3")
STATS = "min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS stdev, count(value)::BIGINT AS samples"


def _tidy(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 9)).withColumn("stdev", F.round("stdev", 6))


@query(M + f"SELECT {STATS} FROM mosaic")
def band_stats(spark, sf_dir):
    return _tidy(R.band_stats(V.mosaic(spark, sf_dir)))


@query(M3 + f"SELECT band, {STATS} FROM mosaic3 GROUP BY band")
def band_information(spark, sf_dir):
    return _tidy(R.band_stats(V.mosaic3(spark, sf_dir), ["band"]))


@query(M3 + f"SELECT band, {STATS} FROM mosaic3 WHERE band = 1 GROUP BY band")
def one_band_information(spark, sf_dir):
    return _tidy(R.band_stats(V.mosaic3(spark, sf_dir).where("band = 1"), ["band"]))


@query(M + f"SELECT {STATS} FROM (SELECT value * 257 AS value FROM mosaic)")
def wide_band_stats(spark, sf_dir):
    """Statistics after 8-bit values are spread over 16 bits."""
    return _tidy(R.band_stats(V.mosaic(spark, sf_dir).withColumn("value", F.col("value") * 257)))


def _hist_sql(source: str, by: str, bins: str, lo: str, hi: str, extra: str = "") -> str:
    b = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""l AS (SELECT {b}{lo} AS lo, {hi} AS hi0 FROM {source} {group}), n AS (SELECT *, {bins} AS n FROM l), k AS (SELECT * REPLACE (n::DOUBLE AS n), CASE WHEN {bool(extra)} THEN lo + ceil((hi0 - lo) / 16) * n ELSE hi0 END AS hi FROM n),
      r AS (SELECT {b}least(floor((value - lo) * n / (hi - lo))::BIGINT, n::BIGINT - 1) AS bin, lo, (hi - lo) / n AS w FROM {source} JOIN k {join} WHERE value >= lo AND value <= hi)
      SELECT {b}bin, count(*)::BIGINT AS count, any_value(lo) + bin * any_value(w) AS edge0, any_value(lo) + (bin + 1) * any_value(w) AS edge1 FROM r GROUP BY {b}bin"""


LOW, HIGH = "min(value)::DOUBLE", "(max(value) + 1)::DOUBLE"


@query(M + ", " + _hist_sql("mosaic", "", "32", LOW, HIGH))
def histogram(spark, sf_dir):
    return R.histogram(V.mosaic(spark, sf_dir), 32)


@query(M3 + ", " + _hist_sql("mosaic3", "band", "16", LOW, HIGH))
def histogram_bands(spark, sf_dir):
    return R.histogram(V.mosaic3(spark, sf_dir), 16, ["band"])


@query(M + ", " + _hist_sql("mosaic", "", "20", "min(100.0::DOUBLE)", "min(150.0::DOUBLE)"))
def histogram_range(spark, sf_dir):
    return R.histogram(V.mosaic(spark, sf_dir), 20, low=100, high=150)


@query(M + ", " + _hist_sql("mosaic", "", "ceil((hi0 - lo) / ceil((hi0 - lo) / 16))", LOW, HIGH, "rounded"))
def histogram_round(spark, sf_dir):
    return R.histogram(V.mosaic(spark, sf_dir), 16, rounded=True)


@query(M + ", h AS (WITH " + _hist_sql("mosaic", "", "32", LOW, HIGH) + ") SELECT *, count / (sum(count) OVER ())::DOUBLE AS density FROM h")
def histogram_density(spark, sf_dir):
    return R.histogram(V.mosaic(spark, sf_dir), 32, density=True)


def _ends(m: DataFrame) -> DataFrame:
    return m.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))


_H = M + ", h AS (WITH " + _hist_sql("mosaic", "", "64", LOW, HIGH) + ")"


@query(_H + ", r AS (SELECT *, row_number() OVER o AS k, sum(count) OVER o AS run, sum(count) OVER () AS n FROM h WINDOW o AS (ORDER BY bin)) SELECT CASE WHEN k = 1 THEN (SELECT min(value) FROM mosaic)::DOUBLE ELSE edge0 END AS threshold FROM r WHERE run > 0.02 * n ORDER BY k LIMIT 1")
def hist_threshold_low(spark, sf_dir):
    m = V.mosaic(spark, sf_dir)
    return R.threshold(R.histogram(m, 64), 0.02, _ends(m))


@query(_H + ", r AS (SELECT *, row_number() OVER o AS k, sum(count) OVER o AS run, sum(count) OVER () AS n FROM h WINDOW o AS (ORDER BY bin DESC)) SELECT CASE WHEN k = 1 THEN (SELECT max(value) FROM mosaic)::DOUBLE ELSE edge1 END AS threshold FROM r WHERE run > 0.02 * n ORDER BY k LIMIT 1")
def hist_threshold_high(spark, sf_dir):
    m = V.mosaic(spark, sf_dir)
    return R.threshold(R.histogram(m, 64), 0.02, _ends(m), from_max=True)


@query(M + "SELECT CASE WHEN min(value) >= 0 AND max(value) <= 255 THEN 0 ELSE min(value) END AS auto_min, CASE WHEN min(value) >= 0 AND max(value) <= 255 THEN 255 ELSE max(value) END AS auto_max, min(value) AS data_min, max(value) AS data_max FROM mosaic")
def auto_minmax(spark, sf_dir):
    """The drawn range: all of an 8-bit type's if the data fit in it, else the data's."""
    s = R.band_stats(V.mosaic(spark, sf_dir))
    byte = (F.col("min") >= 0) & (F.col("max") <= 255)
    return s.select(F.when(byte, 0).otherwise(F.col("min")).alias("auto_min"), F.when(byte, 255).otherwise(F.col("max")).alias("auto_max"), F.col("min").alias("data_min"), F.col("max").alias("data_max"))


def _pyramid_sql(expr: str) -> str:
    return M + f"SELECT x // 2 AS x, y // 2 AS y, {expr} AS value FROM mosaic GROUP BY 1, 2"


for _m, _e in {"mean": "floor(avg(value))::INT", "median": "floor(median(value))::INT", "max": "max(value)", "min": "min(value)"}.items():

    @query(_pyramid_sql(_e), f"pyramid_{_m}")
    def _pyramid(spark, sf_dir, method=_m):
        return R.half(V.mosaic(spark, sf_dir), method, V.WIDTH, V.height(spark, sf_dir))


@query(M + "SELECT x // 2 AS x, y // 2 AS y, value FROM mosaic WHERE x % 2 = 0 AND y % 2 = 0")
def pyramid_nearest(spark, sf_dir):
    return R.half(V.mosaic(spark, sf_dir), "nearest", V.WIDTH, V.height(spark, sf_dir))


@query(M + """, q AS (SELECT x // 2 AS x, y // 2 AS y, list(value ORDER BY x % 2, y % 2) AS v FROM mosaic GROUP BY 1, 2)
  SELECT x, y, CASE WHEN v[2] = v[3] OR v[2] = v[4] THEN v[2] WHEN v[3] = v[4] THEN v[3] ELSE v[1] END AS value FROM q""")
def pyramid_mode(spark, sf_dir):
    return R.half(V.mosaic(spark, sf_dir), "mode", V.WIDTH, V.height(spark, sf_dir))


def _colour_sql(direction: str) -> str:
    return M3 + f""", t AS (SELECT x, y, sum(value) AS s FROM mosaic3 GROUP BY x, y),
      b AS (SELECT x, y FROM t QUALIFY row_number() OVER (PARTITION BY x // 2, y // 2 ORDER BY s {direction}, x % 2, y % 2) = 1)
      SELECT x // 2 AS x, y // 2 AS y, band, value FROM mosaic3 JOIN b USING (x, y)"""


@query(_colour_sql("DESC"))
def pyramid_maxcolor(spark, sf_dir):
    return R.half_by_colour(V.mosaic3(spark, sf_dir))


@query(_colour_sql("ASC"))
def pyramid_mincolor(spark, sf_dir):
    return R.half_by_colour(V.mosaic3(spark, sf_dir), largest=False)


@query(M + """, a AS (SELECT x // 2 AS x, y // 2 AS y, floor(avg(value))::INT AS value FROM mosaic GROUP BY 1, 2), b AS (SELECT x // 2 AS x, y // 2 AS y, floor(avg(value))::INT AS value FROM a GROUP BY 1, 2),
  c AS (SELECT x // 2 AS x, y // 2 AS y, floor(avg(value))::INT AS value FROM b GROUP BY 1, 2)
  SELECT 3 AS level, count(*)::BIGINT AS pixels, sum(value)::BIGINT AS total FROM mosaic UNION ALL SELECT 2, count(*), sum(value)::BIGINT FROM a UNION ALL SELECT 1, count(*), sum(value)::BIGINT FROM b UNION ALL SELECT 0, count(*), sum(value)::BIGINT FROM c""")
def pyramid_levels(spark, sf_dir):
    """Each level from the one above it."""
    level, levels, w, h = V.mosaic(spark, sf_dir), [], V.WIDTH, V.height(spark, sf_dir)
    for k in (3, 2, 1, 0):
        levels.append(level.agg(F.lit(k).alias("level"), F.count("*").alias("pixels"), F.sum("value").alias("total")))
        level, w, h = R.half(level, "mean", w, h), -(-w // 2), -(-h // 2)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


@query(M + """, i AS (SELECT a AS x, b AS y, 17 + floor(a * 120 / 50)::INT AS sx, 9 + floor(b * 100 / 40)::INT AS sy FROM range(50) p(a), range(40) q(b)) SELECT i.x, i.y, m.value FROM i JOIN mosaic m ON m.x = sx AND m.y = sy""")
def region_nearest(spark, sf_dir):
    return R.region_nearest(V.mosaic(spark, sf_dir), 17, 9, 120, 100, 50, 40)


@query(M + f""", z AS (SELECT {V.HEIGHT_SQL} AS h), o AS (SELECT h, least(64, floor(64 * 200 / greatest(200, h))::BIGINT) AS ow, least(64, floor(64 * h / greatest(200, h))::BIGINT) AS oh FROM z),
  i AS (SELECT a AS x, b AS y, floor(a * 200 / ow)::INT AS sx, floor(b * h / oh)::INT AS sy FROM o, range(64) p(a), range(64) q(b) WHERE a < ow AND b < oh) SELECT i.x, i.y, m.value FROM i JOIN mosaic m ON m.x = sx AND m.y = sy""")
def thumbnail(spark, sf_dir):
    """The whole image within 64x64, its shape kept; as in the SQL no pixels if a side comes to less than one."""
    h = V.height(spark, sf_dir)
    side = max(V.WIDTH, h)
    return R.region_nearest(V.mosaic(spark, sf_dir), 0, 0, V.WIDTH, h, 64 * V.WIDTH // side, 64 * h // side)


@query(M + "SELECT value FROM mosaic WHERE x = 57 AND y = 91")
def pixel_lookup(spark, sf_dir):
    return V.mosaic(spark, sf_dir).where("x = 57 AND y = 91").select("value")


@query(V.with_views("frames") + "SELECT frame % 4 * 200 + x AS x, frame // 4 * " + V.HEIGHT_SQL + " + y AS y, value FROM frames")
def frame_mosaic(spark, sf_dir):
    """Frames side by side in a grid of ceil(sqrt(10)) across."""
    return V.frames(spark, sf_dir).select((F.col("frame") % 4 * 200 + F.col("x")).alias("x"), (F.expr("frame div 4") * V.height(spark, sf_dir) + F.col("y")).alias("y"), "value")


RAMP = [0.0, 60.0, 255.0]


@query(M + """, t AS (SELECT x, y, greatest(0.0::DOUBLE, least(2.0::DOUBLE, (value - 80.0::DOUBLE) / 100.0::DOUBLE * 2)) AS t FROM mosaic), k AS (SELECT *, least(floor(t), 1)::INT AS k FROM t)
  SELECT x, y, round([0.0::DOUBLE, 60.0, 255.0][k + 1] + ([0.0::DOUBLE, 60.0, 255.0][k + 2] - [0.0::DOUBLE, 60.0, 255.0][k + 1]) * (t - k), 6) AS value FROM k""")
def style_linear(spark, sf_dir):
    return V.mosaic(spark, sf_dir).select("x", "y", F.round(S.linear(S.rescale(F.col("value"), 80.0, 180.0), RAMP), 6).alias("value"))


@query(M + "SELECT x, y, [10.0::DOUBLE, 90.0, 170.0, 250.0][greatest(0, least(3, floor((value - 80.0::DOUBLE) / 100.0::DOUBLE * 4)))::INT + 1] AS value FROM mosaic")
def style_discrete(spark, sf_dir):
    return V.mosaic(spark, sf_dir).select("x", "y", S.discrete(S.rescale(F.col("value"), 80.0, 180.0), [10.0, 90.0, 170.0, 250.0]).alias("value"))


@query(M + "SELECT x, y, CASE WHEN value <> 127 THEN value ELSE 0 END AS value, CASE WHEN value <> 127 THEN 255 ELSE 0 END AS alpha FROM mosaic")
def style_nodata(spark, sf_dir):
    ok = S.visible(F.col("value"), F.col("value"), nodata=127)
    return V.mosaic(spark, sf_dir).select("x", "y", F.when(ok, F.col("value")).otherwise(0).alias("value"), F.when(ok, 255).otherwise(0).alias("alpha"))


@query(M + ", t AS (SELECT x, y, (value - 100.0::DOUBLE) / 50.0::DOUBLE AS v FROM mosaic) SELECT x, y, CASE WHEN v >= 0 AND v <= 1 THEN floor(v * 255)::INT ELSE 0 END AS value FROM t")
def style_clamp(spark, sf_dir):
    """Values outside the range aren't drawn."""
    v = S.rescale(F.col("value"), 100.0, 150.0)
    return V.mosaic(spark, sf_dir).select("x", "y", F.when(S.visible(F.col("value"), v, clamp=False), F.floor(v * 255)).otherwise(0).cast("int").alias("value"))


_W3 = M3 + ", w AS (SELECT x, y, max(value) FILTER (band = 0) AS r, max(value) FILTER (band = 1) AS g, max(value) FILTER (band = 2) AS b FROM mosaic3 GROUP BY x, y) "


def _wide(spark, sf_dir) -> DataFrame:
    """One row for each pixel with its three bands."""
    band = lambda k: F.max(F.when(F.col("band") == k, F.col("value")))
    return V.mosaic3(spark, sf_dir).groupBy("x", "y").agg(band(0).alias("r"), band(1).alias("g"), band(2).alias("b"))


@query(_W3 + "SELECT x, y, round(r * (g / 255.0::DOUBLE) * (b / 255.0::DOUBLE), 6) AS value FROM w")
def style_multiply(spark, sf_dir):
    return _wide(spark, sf_dir).select("x", "y", F.round(S.multiply(F.col("r"), F.col("g"), F.col("b")), 6).alias("value"))


@query(_W3 + "SELECT x, y, greatest(r, g, b) AS value FROM w")
def style_lighten(spark, sf_dir):
    return _wide(spark, sf_dir).select("x", "y", S.lighten(F.col("r"), F.col("g"), F.col("b")).alias("value"))


@query(M + "SELECT x, y, CASE WHEN value IN (120, 125, 130, 135) THEN 255 ELSE 0 END AS value FROM mosaic")
def mask_pixels(spark, sf_dir):
    return V.mosaic(spark, sf_dir).select("x", "y", F.when(F.col("value").isin(120, 125, 130, 135), 255).otherwise(0).alias("value"))


@query("SELECT o_orderkey, o_orderkey * 37 % 256 AS b0, o_orderkey * 37 // 256 % 256 AS b1, o_orderkey * 37 // 65536 % 256 AS b2 FROM orders")
def pixelmap_encode(spark, sf_dir):
    b = S.label_bytes(F.col("o_orderkey") * 37)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(f"b{k}") for k, c in enumerate(b)])


@query(M + """, s AS (SELECT m.x + dx AS x, m.y + dy AS y, value, CASE WHEN dx = 0 AND dy = 0 THEN value END AS own FROM mosaic m, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE m.x < 100 AND m.y < 80)
  SELECT x, y, greatest(0.0::DOUBLE, least(255.0::DOUBLE, max(own) + (max(own) - median(value)) * 1.0::DOUBLE)) AS value FROM s GROUP BY x, y HAVING max(own) IS NOT NULL""")
def median_filter(spark, sf_dir):
    return R.median_filter(V.mosaic(spark, sf_dir))


_HSI = _W3 + """, c AS (SELECT x, y, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM w), h AS (SELECT x, y, atan2(sqrt(3.0::DOUBLE) * (g - b), 2 * r - g - b) / (2 * pi()) AS h0, (r + g + b) / 3 AS i, least(r, g, b) AS lo FROM c),
  k AS (SELECT x, y, CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END AS h, CASE WHEN i = 0 THEN 0.0 ELSE 1 - lo / i END AS s, i FROM h)"""


@query(_HSI + "SELECT x, y, round(h, 9) AS h, round(s, 9) AS s, round(i, 9) AS i FROM k")
def hsi(spark, sf_dir):
    h, s, i = S.hsi(*[F.col(c) / 255.0 for c in "rgb"])
    return _wide(spark, sf_dir).select("x", "y", F.round(h, 9).alias("h"), F.round(s, 9).alias("s"), F.round(i, 9).alias("i"))


@query(_HSI + """, p AS (SELECT *, abs((h - 0.63 + 0.5) - floor(h - 0.63 + 0.5) - 0.5) <= 0.2 AND s >= 0.05 AND i < 0.95 AND i >= 0.05 AS pos FROM k)
  SELECT CASE WHEN NOT pos THEN 'negative' WHEN i >= 0.52 THEN 'weak' WHEN i < 0.48 THEN 'strong' ELSE 'plain' END AS label, count(*)::BIGINT AS pixels FROM p GROUP BY 1""")
def positive_pixels(spark, sf_dir):
    """Pixels of a hue by strength."""
    h, s, i = S.hsi(*[F.col(c) / 255.0 for c in "rgb"])
    k = _wide(spark, sf_dir).select(h.alias("h"), s.alias("s"), i.alias("i"))
    turn = F.col("h") - 0.63 + 0.5
    pos = (F.abs(turn - F.floor(turn) - 0.5) <= 0.2) & (F.col("s") >= 0.05) & (F.col("i") < 0.95) & (F.col("i") >= 0.05)
    label = F.when(~pos, "negative").when(F.col("i") >= 0.52, "weak").when(F.col("i") < 0.48, "strong").otherwise("plain")
    return k.groupBy(label.alias("label")).agg(F.count("*").alias("pixels"))


_TWO = M + ", t AS (SELECT x, y, value::DOUBLE AS c, (x % 5) / 4.0::DOUBLE AS a FROM mosaic WHERE x >= 40), j AS (SELECT m.x, m.y, coalesce(t.c, 0.0) AS tc, coalesce(t.a, 0.0) AS ta, (255 - m.value)::DOUBLE AS bc, (m.y % 3) / 2.0::DOUBLE AS ba FROM mosaic m LEFT JOIN t ON t.x = m.x AND t.y = m.y)"


@query(_TWO + ", o AS (SELECT *, ta + ba * (1 - ta) AS oa FROM j) SELECT x, y, round((tc * ta + bc * ba * (1 - ta)) / CASE WHEN oa = 0 THEN 1.0 ELSE oa END, 6) AS value, oa AS alpha FROM o")
def rgba_over(spark, sf_dir):
    """One layer over another."""
    m = V.mosaic(spark, sf_dir)
    t = m.where("x >= 40").select("x", "y", F.col("value").cast("double").alias("tc"), ((F.col("x") % 5) / 4.0).alias("ta"))
    b = m.select("x", "y", (255 - F.col("value")).cast("double").alias("bc"), ((F.col("y") % 3) / 2.0).alias("ba"))
    j = b.join(t, ["x", "y"], "left").fillna(0.0, ["tc", "ta"])
    c, a = S.over(F.col("tc"), F.col("ta"), F.col("bc"), F.col("ba"))
    return j.select("x", "y", F.round(c, 6).alias("value"), a.alias("alpha"))


@query(M + """, s AS (SELECT 0 AS seq, x, y, value FROM mosaic WHERE x < 120 UNION ALL SELECT 1, x, y, 255 - value FROM mosaic WHERE x >= 80 AND y < 100 UNION ALL SELECT 2, x, y, value // 2 FROM mosaic WHERE y >= 60)
  SELECT x, y, arg_max(value, seq) AS value FROM s GROUP BY x, y""")
def merge_sources(spark, sf_dir):
    """Opaque sources in list order: the last one on top."""
    m = V.mosaic(spark, sf_dir)
    parts = [m.where("x < 120").withColumn("seq", F.lit(0)), m.where("x >= 80 AND y < 100").withColumns({"value": 255 - F.col("value"), "seq": F.lit(1)}), m.where("y >= 60").withColumns({"value": F.expr("value div 2").cast("int"), "seq": F.lit(2)})]
    return R.last_write(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["x", "y"])


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, (p_size % 13 + 4)::DOUBLE AS h, (p_partkey % 7) * 0.5::DOUBLE AS s11, (p_partkey % 3) * 0.25::DOUBLE AS s12, (p_partkey % 5) * -0.25::DOUBLE AS s21, 1.5::DOUBLE AS s22, (p_partkey % 100)::DOUBLE AS x, (p_partkey % 90)::DOUBLE AS y FROM part)
  SELECT p_partkey, least(x, x + s11 * w, x + s12 * h, x + s11 * w + s12 * h) AS lft, greatest(x, x + s11 * w, x + s12 * h, x + s11 * w + s12 * h) AS rgt, least(y, y + s21 * w, y + s22 * h, y + s21 * w + s22 * h) AS top, greatest(y, y + s21 * w, y + s22 * h, y + s21 * w + s22 * h) AS bot FROM p""")
def source_bbox_affine(spark, sf_dir):
    """Box of an affinely placed source."""
    k = F.col("p_partkey")
    p = V.table(spark, sf_dir, "part").select(
        k, F.col("p_size").cast("double").alias("w"), (F.col("p_size") % 13 + 4).cast("double").alias("h"), (k % 7 * 0.5).alias("s11"), (k % 3 * 0.25).alias("s12"), (k % 5 * -0.25).alias("s21"), F.lit(1.5).alias("s22"), (k % 100).cast("double").alias("x"), (k % 90).cast("double").alias("y")
    )
    xs = [F.expr(e) for e in ("x", "x + s11 * w", "x + s12 * h", "x + s11 * w + s12 * h")]
    ys = [F.expr(e) for e in ("y", "y + s21 * w", "y + s22 * h", "y + s21 * w + s22 * h")]
    return p.select("p_partkey", F.least(*xs).alias("lft"), F.greatest(*xs).alias("rgt"), F.least(*ys).alias("top"), F.greatest(*ys).alias("bot"))


@query("""SELECT c + z * 3 + t * 12 AS frame, c, z, t, CASE WHEN (c + z + t) % 2 = 0 THEN c * 100 + z * 10 + t END AS source FROM range(3) a(c), range(4) b(z), range(2) d(t)""")
def multi_frames_complete(spark, sf_dir):
    """All frames of the axes' ranges, with the source that fills each if there is one."""
    f = spark.range(24).select(F.col("id").alias("frame"), (F.col("id") % 3).alias("c"), (F.expr("id div 3") % 4).alias("z"), F.expr("id div 12").alias("t"))
    given = f.where((F.col("c") + F.col("z") + F.col("t")) % 2 == 0).select("c", "z", "t", (F.col("c") * 100 + F.col("z") * 10 + F.col("t")).alias("source"))
    return f.join(given, ["c", "z", "t"], "left").select("frame", "c", "z", "t", "source")


@query("SELECT user_id % 50 AS x, event_id % 7 AS y, arg_max(value, event_id) AS value, count(*)::BIGINT AS writes FROM events GROUP BY 1, 2")
def sink_last_write(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 50).alias("x"), (F.col("event_id") % 7).alias("y")).agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("writes"))


@query("SELECT user_id % 50 AS x, event_id % 7 AS y, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def sink_masked(spark, sf_dir):
    """Writes under a mask: the others leave what was there."""
    e = V.table(spark, sf_dir, "events").where("event_type <> 'error'").select((F.col("user_id") % 50).alias("x"), (F.col("event_id") % 7).alias("y"), "value", F.col("event_id").alias("seq"))
    return R.last_write(e, ["x", "y"])


@query(M + ", g AS (SELECT a AS x, b AS y FROM range(210) p(a), (SELECT unnest(range(" + V.HEIGHT_SQL + " + 10)) AS b)) SELECT g.x, g.y, coalesce(m.value, 0) AS value FROM g LEFT JOIN mosaic m ON m.x = g.x AND m.y = g.y")
def sink_resize(spark, sf_dir):
    """A raster grown by ten pixels on both axes, the new ones zero."""
    g = spark.range(210 * (V.height(spark, sf_dir) + 10)).select((F.col("id") % 210).alias("x"), F.expr("id div 210").alias("y"))
    return g.join(V.mosaic(spark, sf_dir), ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(0)).alias("value"))


@query(M + ", e AS (SELECT value::DOUBLE AS a, (value // 8 * 8)::DOUBLE AS b FROM mosaic), s AS (SELECT max(abs(a - b)) AS mx, avg(abs(a - b)) AS mn, avg((a - b) * (a - b)) AS ms FROM e) SELECT mx AS max_error, round(mn, 9) AS mean_error, round(sqrt(ms), 9) AS rmse, CASE WHEN ms > 0 THEN round(10 * log10(65025.0::DOUBLE / ms), 9) END AS psnr FROM s")
def error_metrics(spark, sf_dir):
    m = V.mosaic(spark, sf_dir)
    return R.error_metrics(m, m.withColumn("value", F.expr("value div 8") * 8))


_P = lambda v, n: f"pow(2.0, -(ceil(log2({v})) - {n})) - pow(2.0, -ceil(log2({v})))"


@query(f"""WITH g AS (SELECT user_id % 40 AS grp, min((value - user_id % 3 * 40) * pow(10.0, user_id % 8 - 4)) AS lo, max((value - user_id % 3 * 40) * pow(10.0, user_id % 8 - 4)) AS hi FROM events GROUP BY 1)
  SELECT grp, CASE WHEN lo >= 0 AND hi = 0 THEN 'uchar' WHEN lo >= 0 AND hi <= 0.00390625 THEN 'ushort' WHEN lo >= 0 AND hi <= 1 THEN 'ushort' WHEN lo >= 0 AND hi < 256 THEN 'uchar' ELSE 'ushort' END AS format,
   CASE WHEN lo >= 0 THEN 0.0 WHEN lo >= -0.00390625 AND hi <= 0.00390625 THEN 1.0 WHEN lo >= -1 AND hi <= 1 THEN 1.0 WHEN lo >= -32768 AND hi < 32768 THEN 32768.0 ELSE 0.0 END::DOUBLE AS shift,
   round(CASE WHEN lo >= 0 AND hi = 0 THEN 1.0 WHEN lo >= 0 AND hi <= 0.00390625 THEN {_P("hi", 16)} WHEN lo >= 0 AND hi <= 1 THEN 65535.0 WHEN lo >= 0 AND hi < 65536 THEN 1.0 WHEN lo >= 0 THEN {_P("hi", 16)}
     WHEN lo >= -0.00390625 AND hi <= 0.00390625 THEN {_P("hi", 15)} WHEN lo >= -1 AND hi <= 1 THEN 32767.0 WHEN lo >= -32768 AND hi < 32768 THEN 1.0 ELSE {_P("greatest(-lo, hi)", 16)} END::DOUBLE, 9) AS multiplier FROM g""")
def output_type(spark, sf_dir):
    v = (F.col("value") - F.col("user_id") % 3 * 40) * F.pow(F.lit(10.0), F.col("user_id") % 8 - 4)
    g = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("grp")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    t = R.output_type(F.col("lo"), F.col("hi"))
    return g.select("grp", t["format"].alias("format"), t["offset"].alias("shift"), F.round(t["multiplier"], 9).alias("multiplier"))


@query(M + ", t AS (SELECT x // 20 AS tx, y // 20 AS ty, count(*) FILTER (value > 127) AS above, count(*) AS n FROM mosaic GROUP BY 1, 2) SELECT tx, ty, above::BIGINT AS above, n::BIGINT AS n FROM t WHERE above > 0.5 * n")
def mask_tiles(spark, sf_dir):
    """Tiles of which more than half is above the mask's threshold."""
    t = V.mosaic(spark, sf_dir).groupBy(F.expr("x div 20").alias("tx"), F.expr("y div 20").alias("ty")).agg(F.count_if(F.col("value") > 127).alias("above"), F.count("*").alias("n"))
    return t.where(F.col("above") > 0.5 * F.col("n"))


@query("""WITH p AS (SELECT id % 128 AS x, id // 128 AS y FROM range(16384) t(id)) SELECT x, y, (x % 128 BETWEEN 32 AND 95 AND y % 128 BETWEEN 32 AND 95) OR (x % 64 BETWEEN 16 AND 47 AND y % 64 BETWEEN 16 AND 47) OR (x % 32 BETWEEN 8 AND 23 AND y % 32 BETWEEN 8 AND 23) OR (x % 16 BETWEEN 4 AND 11 AND y % 16 BETWEEN 4 AND 11) AS filled FROM p""")
def synthetic_source(spark, sf_dir):
    from tilewright.sources.synthetic import squares

    return squares(spark, 128, 4)


@query("SELECT t.id AS x, r % 4 AS band, (t.id * 7 + r * 13) % 256 AS value FROM range(256) t(id), range(4) b(r)")
def synthetic_bands(spark, sf_dir):
    return spark.range(1024).select((F.expr("id div 4")).alias("x"), (F.col("id") % 4).alias("band"), ((F.expr("id div 4") * 7 + F.col("id") % 4 * 13) % 256).alias("value"))


@query(M + ", e AS (SELECT x, y, value, x // 8 AS tx, y // 8 AS ty FROM mosaic) SELECT tx, ty, round(avg(value), 9) AS mean, max(value) AS peak FROM e GROUP BY tx, ty HAVING max(value) > 150")
def empty_level_tiles(spark, sf_dir):
    """Tiles of a missing level, made from the nearest populated one."""
    e = V.mosaic(spark, sf_dir).groupBy(F.expr("x div 8").alias("tx"), F.expr("y div 8").alias("ty"))
    return e.agg(F.round(F.avg("value"), 9).alias("mean"), F.max("value").alias("peak")).where("peak > 150")


@query(M + "SELECT value AS v, count(*)::BIGINT AS n, (sum(count(*)) OVER (ORDER BY value))::BIGINT AS run FROM mosaic GROUP BY value")
def cumulative_histogram(spark, sf_dir):
    """Running count by value: the window is over distinct values only."""
    h = V.mosaic(spark, sf_dir).groupBy(F.col("value").alias("v")).agg(F.count("*").alias("n"))
    return h.withColumn("run", F.sum("n").over(Window.orderBy("v")))


@query("""SELECT p_partkey, round(6.378e6 * acos(least(1.0, sin(a) * sin(b) + cos(a) * cos(b) * cos(d))), 3) AS metres FROM (SELECT p_partkey, radians(p_size * 1.0) AS a, radians(p_size + 0.5) AS b, radians((p_partkey % 90) * 0.1::DOUBLE) AS d FROM part)""")
def pixel_size_m(spark, sf_dir):
    """Distance on a sphere by the law of cosines."""
    a, b, d = F.radians(F.col("p_size") * 1.0), F.radians(F.col("p_size") + 0.5), F.radians(F.col("p_partkey") % 90 * 0.1)
    arc = F.acos(F.least(F.lit(1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.round(6.378e6 * arc, 3).alias("metres"))


@query("SELECT p_partkey, 500000.0 + 30.0 * (p_partkey % 100) - 2.5 * p_size AS px, 4100000.0 + 1.5 * (p_partkey % 100) - 30.0 * p_size AS py FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part)")
def pixel_to_projection(spark, sf_dir):
    """Affine pixel-to-map coordinates."""
    x, y = F.col("p_partkey") % 100, F.col("p_size").cast("double")
    return V.table(spark, sf_dir, "part").select("p_partkey", (500000.0 + 30.0 * x - 2.5 * y).alias("px"), (4100000.0 + 1.5 * x - 30.0 * y).alias("py"))


@query("""WITH c AS (SELECT p_partkey, unnest([0.0, 0.0, p_size, p_size])::DOUBLE AS x, unnest([0.0, 7.0, 0.0, 7.0])::DOUBLE AS y FROM part), m AS (SELECT p_partkey, -170 + p_partkey % 300 + 2.0 * x - 0.5 * y AS lon, 80 - 3.0 * y + 0.25 * x AS lat FROM c)
  SELECT p_partkey, min((lon + 180) - 360 * floor((lon + 180) / 360) - 180) AS west, max((lon + 180) - 360 * floor((lon + 180) / 360) - 180) AS east, min(greatest(-89.999999, least(89.999999, lat)))::DOUBLE AS south, max(greatest(-89.999999, least(89.999999, lat)))::DOUBLE AS north FROM m GROUP BY p_partkey""")
def geo_bounds(spark, sf_dir):
    """Corners in longitude and latitude, wrapped and clamped."""
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    corners = [(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(7.0)), (w, F.lit(0.0)), (w, F.lit(7.0))]
    lon = [-170 + k % 300 + 2.0 * x - 0.5 * y for x, y in corners]
    lon = [c + 180 - 360 * F.floor((c + 180) / 360) - 180 for c in lon]
    lat = [F.greatest(F.lit(-89.999999), F.least(F.lit(89.999999), 80 - 3.0 * y + 0.25 * x)) for x, y in corners]
    return V.table(spark, sf_dir, "part").select(k, F.least(*lon).alias("west"), F.greatest(*lon).alias("east"), F.least(*lat).alias("south"), F.greatest(*lat).alias("north"))
