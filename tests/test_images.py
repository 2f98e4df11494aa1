"""Picture files: round trips, and tile rows against whole pictures."""

import numpy as np
import pytest

from tilewright.operators import tiles as T
from tilewright.sources import images as I


@pytest.mark.parametrize("shape, dtype", [((7, 9), np.uint8), ((5, 6, 3), np.uint8), ((4, 3, 4), np.uint16), ((3, 8, 2), np.uint8)])
def test_png_round_trip(shape, dtype):
    p = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    assert (I.read_png(I.write_png(p)).reshape(shape) == p).all()


def test_png_filters():
    """Lines under each of the five filters, made by the definitions."""
    rng = np.random.default_rng(2)
    lines = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    coded = []
    for kind in range(5):
        line, above = lines[kind].astype(int), (lines[kind - 1].astype(int) if kind else np.zeros(12, int))
        out = []
        for k in range(12):
            a, b, c = (line[k - 3] if k >= 3 else 0), above[k], (above[k - 3] if k >= 3 else 0)
            p = a + b - c
            near = sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[0][2]
            out.append((line[k] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        coded.append(np.array(out, np.uint8))
    above = np.zeros(12, np.uint8)
    for kind in range(5):
        above = I._unfilter(kind, coded[kind], above, 3)
        assert (above == lines[kind]).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    full = rng.integers(0, 256, (100, 150, 3)).astype(np.uint8)
    levels = [full, T.halved(full), T.halved(T.halved(full))]
    I.write_tiff(str(root / "a.tif"), levels, 32, mm=0.0005)
    (root / "b.png").write_bytes(I.write_png(full[:20, :30]))
    (root / "c.txt").write_text("no picture")
    return root, levels


def test_tiff(folder):
    root, levels = folder
    t = I.TiffFile(str(root / "a.tif"))
    assert t.levels() == [(0, 2, 0), (0, 1, 1), (0, 0, 2)] and t.millimetres() == pytest.approx(0.0005, rel=1e-5)
    with open(root / "a.tif", "rb") as f:
        for k, want in enumerate(levels):
            got = np.zeros_like(want)
            for i in range(t.tiles(k)):
                x, y, p = t.tile(f, k, i)
                got[y : y + p.shape[0], x : x + p.shape[1]] = p
            assert (got == want).all()
    assert [I.can_read(str(root / n)) for n in ("a.tif", "b.png", "c.txt", "none")] == ["tiff", "png", None, None]


def test_data_source_and_pyramid(spark, folder):
    root, levels = folder
    spark.dataSource.register(I.ImageTiles)
    tiles = spark.read.format("image_tiles").option("tilesPerTask", 5).load(str(root)).where("path LIKE '%a.tif'")
    assert tiles.where("level = 2").count() == 20
    above = T.next_level(tiles.where("level = 2"), 32)
    got = np.zeros_like(levels[1])
    for r in above.collect():
        got[r.y : r.y + r.height, r.x : r.x + r.width] = T.array_of(r.asDict())
    assert (got == levels[1]).all()
    bright = T.map_tiles(tiles.where("level = 0"), lambda a, r: 255 - a)
    total = T.pixels(bright).agg({"value": "sum"}).first()[0]
    assert total == (255 - levels[2].astype(int)).sum()


def test_packbits():
    assert I._packbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == b"\1\2\3\x09\x09\x09\7"
