import numpy as np
import pytest

from tilewright.raster import Raster
from tilewright.sources import tiles_source


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(0).integers(0, 255, (45, 70))


@pytest.fixture(scope="module")
def raster(spark, values):
    rows = [(x, y, int(values[y, x])) for y in range(45) for x in range(70)]
    return Raster(spark.createDataFrame(rows, "x long, y long, value int"), 70, 45, tile=16, magnification=20, mm=0.0005)


def image(df, w, h):
    out = np.full((h, w), -1)
    for r in df.collect():
        out[r.y, r.x] = r.value
    return out


def test_metadata(raster):
    assert raster.levels == 4 and raster.at_level(3)["scale"] == 1 and raster.at_level(1)["magnification"] == 5
    assert raster.tile_count(overlap=4) == raster.tiles(overlap=4).count()


def test_region_and_pixel(raster, values):
    assert (image(raster.region(5, 6, 20, 10), 20, 10) == values[6:16, 5:25]).all()
    assert (image(raster.region(0, 0, 70, 45, 35, 9), 35, 9) == values[::5, ::2]).all()
    assert raster.pixel(3, 4).first().value == values[4, 3]
    assert raster.thumbnail(35, 35).count() == 35 * 22


def test_tiles_hold_their_pixels(raster, values):
    sums = {r["position"]: r["sum(value)"] for r in raster.tile_pixels(overlap=4).groupBy("position").sum("value").collect()}
    for t in raster.tiles(overlap=4).collect():
        assert sums[t.position] == values[t.y : t.y + t.height, t.x : t.x + t.width].sum()


def test_statistics(raster, values):
    s = raster.band_information().first()
    assert (s["min"], s["max"], s.samples) == (values.min(), values.max(), values.size)
    assert s["mean"] == pytest.approx(values.mean()) and s.stdev == pytest.approx(values.std())
    want, _ = np.histogram(values, 10, (values.min(), values.max() + 1))
    got = {r.bin: r["count"] for r in raster.histogram(10).collect()}
    assert [got.get(k, 0) for k in range(10)] == want.tolist()


def test_pyramid_is_written_and_read_by_level(spark, raster, tmp_path):
    raster.write(str(tmp_path / "p"))
    levels = {r.level: r["count"] for r in tiles_source.read_tiles(spark, str(tmp_path / "p")).groupBy("level").count().collect()}
    assert levels == {3: 70 * 45, 2: 35 * 23, 1: 18 * 12, 0: 9 * 6}


def test_deep_zoom_folder(spark, tmp_path):
    for name in ("a_files/0/0_0.png", "a_files/1/1_0.png", "a_files/1/1_0.txt/x", "b_files/2/3_4.jpeg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    got = {(r.image, r.level, r.tx, r.ty, r.format) for r in tiles_source.deep_zoom(spark, str(tmp_path)).collect()}
    assert got == {("a", 0, 0, 0, "png"), ("a", 1, 1, 0, "png"), ("b", 2, 3, 4, "jpeg")}
