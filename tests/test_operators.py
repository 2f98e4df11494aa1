"""Operators on small fixtures, with values worked out by hand or by brute force."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import style as S
from tilewright.functions.json_patch import apply_patch
from tilewright.operators import batches as B
from tilewright.operators import catalog as C
from tilewright.operators import elements as E
from tilewright.operators import raster as R
from tilewright.operators import tabular as P
from tilewright.operators import tiling as T
from tilewright.streaming import tiles as W


def test_grid_covers_the_image_once(spark):
    x, y = T.Axis(120, 50), T.Axis(90, 40)
    seen = np.zeros((90, 120), int)
    for r in T.tile_grid(spark, x, y).collect():
        seen[r.y : r.y + r.height, r.x : r.x + r.width] += 1
    assert (seen == 1).all()


@pytest.mark.parametrize("overlap, edges", [(10, False), (11, False), (10, True)])
def test_tiles_without_overlap_cover_the_image_once(spark, overlap, edges):
    x, y = T.Axis(120, 50, overlap, edges=edges), T.Axis(90, 40, overlap, edges=edges)
    seen = np.zeros((90, 120), int)
    for r in T.tile_grid(spark, x, y).collect():
        seen[r.y + r.overlap_top : r.y + r.height - r.overlap_bottom, r.x + r.overlap_left : r.x + r.width - r.overlap_right] += 1
    assert seen.min() >= 1 if edges else (seen == 1).all()


def test_pixels_go_to_all_their_tiles(spark):
    x, y = T.Axis(60, 25, 6), T.Axis(40, 20, 4)
    pixels = spark.range(2400).select((F.col("id") % 60).alias("x"), F.expr("id div 60").alias("y"), F.lit(1).alias("value"))
    got = {r.position: r.n for r in T.pixels_in_tiles(pixels, x, y).groupBy("position").agg(F.count("*").alias("n")).collect()}
    want = {r.position: r.width * r.height for r in T.tile_grid(spark, x, y).collect()}
    assert got == want


def test_overlap_must_be_smaller_than_the_tile():
    with pytest.raises(ValueError):
        T.Axis(100, 10, 10)


def test_half_with_odd_sides(spark):
    values = np.arange(15).reshape(3, 5) ** 2
    rows = spark.createDataFrame([(x, y, int(values[y, x])) for y in range(3) for x in range(5)], "x long, y long, value int")
    padded = np.pad(values, ((0, 1), (0, 1)), mode="edge")
    blocks = padded.reshape(2, 2, 3, 2).transpose(0, 2, 1, 3).reshape(2, 3, 4)
    for method, want in (("mean", blocks.mean(2).astype(int)), ("median", np.median(blocks, 2).astype(int)), ("max", blocks.max(2)), ("min", blocks.min(2))):
        got = {(r.y, r.x): r.value for r in R.half(rows, method, 5, 3).collect()}
        assert got == {(j, i): want[j, i] for j in range(2) for i in range(3)}, method


def test_mode_takes_the_second_pixel_of_a_pair(spark):
    rows = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 0, 7), (1, 1, 4)], "x long, y long, value int")
    assert R.half(rows, "mode", 2, 2).first().value == 4


def test_histogram_right_edge_belongs_to_the_last_bin(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 4)], "value int")
    got = {r.bin: r["count"] for r in R.histogram(rows, 2, low=0, high=4).collect()}
    assert got == {0: 2, 1: 4}


def test_error_metrics_of_equal_rasters(spark):
    a = spark.createDataFrame([(0, 0, 5), (1, 0, 6)], "x long, y long, value int")
    r = R.error_metrics(a, a).first()
    assert r.max_error == 0 and r.psnr is None


def test_palettes(spark):
    got = spark.range(5).select(S.linear(F.col("id") / 4, [0.0, 10.0, 30.0]).alias("l"), S.discrete(F.col("id") / 4, [1.0, 2.0]).alias("d")).collect()
    assert [r.l for r in got] == [0, 5, 10, 20, 30]
    assert [r.d for r in got] == [1, 1, 2, 2, 2]


def test_budget_keeps_the_row_that_crosses_it(spark):
    rows = spark.createDataFrame([(k, 4) for k in range(10)], "id long, details int")
    assert E.within_budget(rows, [F.col("id")], 10).count() == 3
    assert E.within_budget(rows, [F.col("id")], 5, 6).count() == 6


def test_band_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, (60, 4)).astype(float), rng.integers(0, 30, (60, 4)).astype(float)
    frame = lambda m: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(m)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.a_id, r.b_id) for r in E.band_join(frame(a), frame(b), 4.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if (abs(a[i] - b[j]) <= 4).all()}


def _kd_by_sorting(rows, depth):
    """chunk by id of rows (id, x, y) whose halves are found by sorting."""
    parts = [(0, rows)]
    for level in range(depth):
        last = lambda r: [(v is None, v or 0) for v in (r[1 + level % 2], r[0])]
        parts = [(c * 2 + h, part) for c, p in parts for h, part in enumerate((sorted(p, key=last)[: -(-len(p) // 2)], sorted(p, key=last)[-(-len(p) // 2) :]))]
    return sorted((r[0], c) for c, p in parts for r in p)


@pytest.mark.parametrize("n, distinct", [(0, 5), (1, 5), (6, 2), (97, 7), (97, 1000)])
def test_kd_chunks_against_sorting(spark, monkeypatch, n, distinct):
    rng = np.random.default_rng(n + distinct)
    rows = [(int(k), *[float(v) if v % 11 else None for v in r]) for k, r in zip(rng.permutation(n), rng.integers(0, distinct, (n, 2)) + 1, strict=True)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    for few in (B.FEW, 3):  # all at once, and by quantiles
        monkeypatch.setattr(B, "FEW", few)
        got = sorted((r.id, r.chunk) for r in B.kd_chunks(points, 3, key="id").collect())
        assert got == _kd_by_sorting(rows, 3), few


def test_kd_chunks_of_copies(spark):
    """Rows that are alike in all columns are dealt to both halves."""
    points = spark.createDataFrame([(7, 1.0, 2.0)] * 8 + [(2**60 + 1, 3.0, 4.0)] * 4, "id long, x double, y double")
    got = B.kd_chunks(points, 2, key="id").groupBy("chunk").agg(F.count("*").alias("n")).collect()
    assert {r.chunk: r.n for r in got} == {0: 3, 1: 3, 2: 3, 3: 3}


def test_kth_of_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(B, "FEW", 2)
    rows = spark.createDataFrame([(2**60 + k // 2,) for k in range(30)], "id long")
    assert [B._kth(rows, "id", k, 30) for k in (0, 13, 29)] == [(2**60, 0, 2), (2**60 + 6, 12, 2), (2**60 + 14, 28, 2)]


def test_kd_chunks_sort_nothing(spark):
    """A window over all points would bring them to one task."""
    plan = B.kd_chunks(spark.range(50).selectExpr("id", "id % 7 AS x", "id % 5 AS y"), 2, key="id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Window|Exchange|Sort", plan)


@pytest.mark.parametrize("tolerance", [0.0, 0.1, 2.0])
def test_band_join_at_the_edges_of_cells(spark, tolerance):
    a = [k * tolerance / 2 - 7 for k in range(80)] if tolerance else [-13.0, -1.0, 0.0, 1.0, 13.0]
    frame = lambda: spark.createDataFrame([(k, v, v, v, v) for k, v in enumerate(a)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.a_id, r.b_id) for r in E.band_join(frame(), frame(), tolerance).collect())
    assert got == sorted((i, j) for i, v in enumerate(a) for j, w in enumerate(a) if abs(v - w) <= tolerance)


def test_band_join_sends_few_boxes_twice(spark):
    """Rows that the join reads of the side that is sent to several cells."""
    rng = np.random.default_rng(5)
    boxes = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rng.integers(0, 10_000, (2000, 4)))], "id long, x0 double, y0 double, x1 double, y1 double")
    plan = E.band_join(boxes, boxes, 2.0)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert 2000 < spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.right()).count() < 2 * 2000


@pytest.mark.parametrize("text, want", [("40", (40.0, 10.0)), ("12", (12.0, 1.0)), ("0.25", (0.25, 0.01)), ("-3", (-3.0, 1.0)), ("x", None)])
def test_number_step(text, want):
    got = C.number_step(text)
    assert got == want if want is None else got == pytest.approx(want)


def test_filter_terms():
    assert C.parse_filter('brand:"A b" type:-x,y z') == [("brand", False, [("A b", True)]), ("type", True, [("x", False), ("y", False)]), (None, False, [("z", False)])]


def test_descendants(spark):
    f = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 9)], "folder int, parent int")
    assert {r.folder for r in C.descendants(f, 1).collect()} == {1, 2, 3, 4}


def test_name_match_splits_on_any_punctuation(spark):
    names = spark.createDataFrame([("Slide_été-7.svs",), ("x",)], "name string")
    assert [r.m for r in names.select(C.name_match(F.col("name"), "Été").alias("m")).collect()] == [True, False]


def test_metadata_null_deletes(spark):
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "now map<string,string>, change map<string,string>")
    assert m.select(C.set_metadata(F.col("now"), F.col("change")).alias("m")).first().m == {"a": "1", "c": "3"}


def test_values_fall_back_to_the_parent(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "i long, a long")
    values = spark.createDataFrame([(1, 10, 5), (1, None, 6), (None, None, 7)], "i long, a long, value long")
    got = {(r.i, r.a): r.v for r in P.fill_from_parents(rows, {"v": values}, ["i", "a"]).collect()}
    assert got == {(1, 10): 5, (1, 11): 6, (2, 20): 7}


def test_column_types(spark):
    cells = spark.createDataFrame([("a", "1"), ("a", "2.5"), ("b", "1"), ("b", "x"), ("b", None), ("a", "")], "key string, value string")
    got = {r.key: (r.type, r["count"], r.distinct_values) for r in P.column_catalogue(cells).collect()}
    assert got == {"a": ("number", 2, "1|2.5"), "b": ("string", 2, "1|x")}


@pytest.mark.parametrize(
    "patch, want",
    [
        ([{"op": "add", "path": "/a/b", "value": 1}], {"a": {"b": 1}, "l": [1, 2]}),
        ([{"op": "add", "path": "/l/-", "value": 3}], {"a": {}, "l": [1, 2, 3]}),
        ([{"op": "remove", "path": "/l/0"}], {"a": {}, "l": [2]}),
        ([{"op": "replace", "path": "/x", "value": 1}], None),
        ([{"op": "move", "path": "/a"}], None),
    ],
)
def test_json_patch(patch, want):
    got = apply_patch('{"a": {}, "l": [1, 2]}', json.dumps(patch))
    assert (json.loads(got) if got else None) == want


def test_streamed_sink_keeps_the_last_write(spark, tmp_path):
    rows = [(1, 0, 0, 5.0), (2, 0, 0, 7.0), (3, 1, 0, 9.0), (2, 1, 0, 1.0)]
    spark.createDataFrame(rows[:2], W.WRITES).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[2:], W.WRITES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = W.last_writes(W.writes(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("sink").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {(r.x, r.y): r.value for r in spark.table("sink").collect()} == {(0, 0): 7.0, (1, 0): 9.0}
