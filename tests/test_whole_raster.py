"""Raster queries over the whole raster, whatever the table's size."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import raster as R
from tilewright.plans import ORACLES, QUERIES
from tilewright.sources import views as V


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Folder with 602 vectors, and their values."""
    folder = tmp_path_factory.mktemp("raster")
    e = np.random.default_rng(8).uniform(-0.4, 0.4, (602, 64)).astype(np.float32)
    rows = [(k, v.tolist(), k % 10) for k, v in enumerate(e)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), np.floor((e.astype(float) + 1) * 127.5).astype(int)


def test_three_bands_hold_all_whole_tiles(spark, vectors):
    folder, values = vectors
    got = {(r.band, r.x, r.y): r.value for r in V.mosaic3(spark, folder).collect()}
    want = {(k % 3, k // 3 % 13 * 8 + d % 8, k // 3 // 13 * 8 + d // 8): values[k, d] for k in range(600) for d in range(64)}
    assert got == want


def test_median_filter_of_the_whole_raster(spark, vectors):
    folder, values = vectors
    raster = {(k % 25 * 8 + d % 8, k // 25 * 8 + d // 8): values[k, d] for k in range(602) for d in range(64)}
    got = {(r.x, r.y): r.value for r in QUERIES["median_filter"](spark, folder).collect()}
    assert got.keys() == raster.keys()
    for (x, y), v in raster.items():
        m = np.median([raster[x + i, y + j] for i in range(-2, 3) for j in range(-2, 3) if (x + i, y + j) in raster])
        assert got[x, y] == min(255.0, max(0.0, v + (v - m)))


def test_thumbnail_of_a_raster_too_narrow_for_a_pixel(spark, tmp_path):
    e = spark.createDataFrame([(0, [0.1] * 64, 1), (40_000, [0.2] * 64, 1)], "vec_id long, embedding array<float>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["thumbnail"](spark, str(tmp_path))
    want = duckdb.sql(ORACLES["thumbnail"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert got.columns == ["x", "y", "value"] and got.collect() == want == []


def test_region_without_a_side_is_empty(spark):
    pixels = spark.range(12).select((F.col("id") % 4).alias("x"), F.expr("id div 4").alias("y"), F.col("id").cast("int").alias("value"))
    assert R.region_nearest(pixels, 0, 0, 4, 3, 0, 3).collect() == []
    assert {(r.x, r.y): r.value for r in R.region_nearest(pixels, 0, 0, 4, 3, 3, 2).collect()} == {(i, j): i * 4 // 3 + j * 3 // 2 * 4 for i in range(3) for j in range(2)}


def test_letterbox_joins_the_raster_only(spark, vectors):
    """The square around a raster grows with the square of its height: it must not be shuffled."""
    folder, values = vectors
    box = QUERIES["letterbox"](spark, folder)
    raster = {(k % 25 * 8 + d % 8, k // 25 * 8 + d // 8): values[k, d] for k in range(602) for d in range(64)}
    assert {(r.x, r.y): r.value for r in box.collect()} == {(x, y): raster.get((x - 10, y - 10), 255) for x in range(220) for y in range(220)}
    joined = re.findall(r"Join.*?Range \(0, (\d+)", box._jdf.queryExecution().optimizedPlan().toString(), re.S)
    assert joined == [str(200 * 200)]


@pytest.mark.parametrize("left, top", [(0, 0), (3, 1), (5, 4)])
def test_canvas_holds_every_cell_once(spark, left, top):
    pixels = spark.range(12).where("id <> 7").select((F.col("id") % 4).alias("x"), F.expr("id div 4").alias("y"), F.col("id").cast("int").alias("value"))
    got = sorted((r.x, r.y, r.value) for r in R.on_canvas(pixels, 4, 3, 9, 7, left, top, -1).collect())
    inside = lambda x, y: left <= x < left + 4 and top <= y < top + 3 and (x, y) != (left + 3, top + 1)
    assert got == sorted((x, y, x - left + (y - top) * 4 if inside(x, y) else -1) for x in range(9) for y in range(7))
