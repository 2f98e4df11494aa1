"""Tile rows: a binary array for each tile, changed by numpy a batch at a time.

A tile row is (frame, level, x, y, width, height, bands, dtype, data).  Only whole tiles are shuffled, to their parent
tile when a level is halved; pixels never become rows unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "frame int, level int, x int, y int, width int, height int, bands int, dtype string, data binary"
NAMES = [c.split()[0] for c in TILE.split(", ")]


def array_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], row["dtype"]).reshape(row["height"], row["width"], row["bands"])


def row_of(picture: np.ndarray, **place) -> dict:
    h, w, b = picture.shape
    return {**place, "width": w, "height": h, "bands": b, "dtype": picture.dtype.name, "data": picture.tobytes()}


def _schema() -> pa.Schema:
    return pa.schema([(c, {"dtype": pa.string(), "data": pa.binary()}.get(c, pa.int32())) for c in NAMES])


def map_tiles(tiles: DataFrame, change) -> DataFrame:
    """``change(array, row) -> array`` on every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([row_of(np.ascontiguousarray(change(array_of(row), row)), **{c: row[c] for c in ("frame", "level", "x", "y")})], schema=_schema())

    return tiles.select(*NAMES).mapInArrow(run, TILE)


def halved(picture: np.ndarray, method: str = "mean") -> np.ndarray:
    """Half size by 2x2 blocks; an odd last row or column counts twice."""
    h, w, b = picture.shape
    p = np.pad(picture, ((0, h % 2), (0, w % 2), (0, 0)), "edge")
    blocks = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2, b)
    if method == "nearest":
        return blocks[:, 0, :, 0]
    if method == "mean":
        out = blocks.mean((1, 3), dtype=np.float64)
        return out.astype(picture.dtype) if picture.dtype.kind == "f" else np.floor(out).astype(picture.dtype)
    if method in ("max", "min"):
        return getattr(blocks, method)((1, 3))
    raise ValueError(f"unknown method {method}")


def next_level(tiles: DataFrame, tile: int, method: str = "mean") -> DataFrame:
    """The level above: four tiles of even size make one, wherever some of them are missing (their place is zero)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        at = [(r["y"] // 2 // tile * tile, r["x"] // 2 // tile * tile) for r in rows]
        top, left = at[0]
        parts = [(r["y"] // 2 - top, r["x"] // 2 - left, halved(array_of(r), method)) for r in rows]
        h, w = max(y + p.shape[0] for y, _, p in parts), max(x + p.shape[1] for _, x, p in parts)
        out = np.zeros((h, w, parts[0][2].shape[2]), parts[0][2].dtype)
        for y, x, p in parts:
            out[y : y + p.shape[0], x : x + p.shape[1]] = p
        return pa.Table.from_pylist([row_of(out, frame=rows[0]["frame"], level=rows[0]["level"] - 1, x=left, y=top)], schema=_schema())

    if tile % 2:
        raise ValueError("tiles of an odd size can't be halved one by one")
    keyed = tiles.select(*NAMES, F.expr(f"x div {2 * tile}").alias("px"), F.expr(f"y div {2 * tile}").alias("py"))
    return keyed.groupBy("frame", "px", "py").applyInArrow(lambda t: run(t.select(NAMES)), TILE)


def pixels(tiles: DataFrame) -> DataFrame:
    """frame, level, band, x, y, value of every pixel, for the operators on pixels."""
    spec = "frame int, level int, band int, x int, y int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = array_of(r)
                y, x, b = np.indices(a.shape)
                n = a.size
                cols = [np.full(n, r["frame"], np.int32), np.full(n, r["level"], np.int32), b.ravel().astype(np.int32), (x.ravel() + r["x"]).astype(np.int32), (y.ravel() + r["y"]).astype(np.int32), a.ravel().astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["frame", "level", "band", "x", "y", "value"])

    return tiles.select(*NAMES).mapInArrow(run, spec)
