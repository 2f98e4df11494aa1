"""PNG and TIFF files as tile tables, with the standard library and numpy.

``spark.dataSource.register(ImageTiles)`` and ``spark.read.format("image_tiles").load(path)`` give a row for each stored
tile or strip of all levels: frame, level, x, y, width, height, bands, dtype, data.  A partition holds some of the tiles, and a
task reads only their bytes.  Read are PNG (8 and 16 bits, without interlace) and TIFF or BigTIFF of either byte order,
tiled or in strips, uncompressed, deflate or PackBits, with or without horizontal prediction.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the two formats.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_BANDS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TIFF_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def read_png(data: bytes) -> np.ndarray:
    """(height, width, bands) of a PNG; palettes become red, green, blue (and alpha)."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, palette, alpha = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if interlace or depth not in (8, 16):
        raise ValueError("interlaced pictures and depths other than 8 and 16 aren't read")
    bands, step = PNG_BANDS[colour], depth // 8
    pixel, line = bands * step, width * bands * step
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, pixel)
    picture = out.view(">u2").astype(np.uint16) if step == 2 else out
    picture = picture.reshape(height, width, bands)
    if colour == 3:
        full = palette if alpha is None else np.concatenate((palette, np.append(alpha, np.full(len(palette) - len(alpha), 255, np.uint8))[:, None]), 1)
        picture = full[picture[..., 0]]
    return picture


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, pixel: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:  # each byte adds the one a pixel before
        return np.add.accumulate(line.reshape(-1, pixel), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out = np.zeros(len(line) + pixel, np.int64)
    up = np.concatenate((np.zeros(pixel, np.int64), above.astype(np.int64)))
    for k in range(pixel, len(out)):
        a, b, c = int(out[k - pixel]), int(up[k]), int(up[k - pixel])
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (int(line[k - pixel]) + guess) & 255
    return out[pixel:].astype(np.uint8)


def write_png(picture: np.ndarray) -> bytes:
    """A PNG of (height, width) or (height, width, bands) numbers of 8 or 16 bits."""
    picture = picture[..., None] if picture.ndim == 2 else picture
    height, width, bands = picture.shape
    depth = picture.dtype.itemsize * 8
    lines = np.ascontiguousarray(picture.astype(">u2") if depth == 16 else picture).view(np.uint8).reshape(height, -1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, depth, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    body = zlib.compress(np.concatenate((np.zeros((height, 1), np.uint8), lines), 1).tobytes())
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


class TiffFile:
    """The directories of a TIFF, and the tiles of each."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            head = f.read(16)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
            version = struct.unpack(self.order + "H", head[2:4])[0] if self.order else 0
            if version not in (42, 43):
                raise ValueError("not a TIFF file")
            self.big = version == 43
            at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
            self.directories: list[dict[int, tuple]] = []
            seen = set()
            while at and at not in seen:
                seen.add(at)
                tags, at = self._directory(f, at)
                self.directories.append(tags)

    def _directory(self, f, at: int) -> tuple[dict[int, tuple], int]:
        o, big = self.order, self.big
        f.seek(at)
        n = struct.unpack(o + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        entry = 20 if big else 12
        block = f.read(n * entry + (8 if big else 4))
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(o + "HH", block, k * entry)
            count = struct.unpack_from(o + ("Q" if big else "I"), block, k * entry + 4)[0]
            size, inline = TIFF_SIZES.get(kind, 1) * count, 8 if big else 4
            value = block[k * entry + entry - inline : k * entry + entry]
            if size > inline:
                f.seek(struct.unpack(o + ("Q" if big else "I"), value)[0])
                value = f.read(size)
            if kind in (5, 10):
                pair = struct.unpack(f"{o}{2 * count}{'I' if kind == 5 else 'i'}", value[:size])
                tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pair[::2], pair[1::2], strict=True))
            elif kind in TIFF_CODES:
                tags[tag] = struct.unpack(f"{o}{count}{TIFF_CODES[kind]}", value[:size])
            else:
                tags[tag] = (value[:size],)
        return tags, struct.unpack(o + ("Q" if big else "I"), block[n * entry :])[0]

    def shape(self, k: int) -> dict:
        t = self.directories[k]
        width, height = t[256][0], t[257][0]
        tiled = 322 in t
        bits, kind = t.get(258, (1,))[0], t.get(339, (1,))[0]
        return {
            "width": width, "height": height, "bands": t.get(277, (1,))[0], "tile_width": t[322][0] if tiled else width, "tile_height": t[323][0] if tiled else min(t.get(278, (height,))[0], height),
            "tiled": tiled, "dtype": f"{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}", "reduced": bool(t.get(254, (0,))[0] & 1),
        }

    def millimetres(self, k: int = 0) -> float | None:
        """Millimetres of a pixel, from the resolution tags."""
        t = self.directories[k]
        per = {2: 25.4, 3: 10.0}.get(t.get(296, (2,))[0])
        return per / t[282][0] if per and 282 in t and t[282][0] else None

    def levels(self) -> list[tuple[int, int, int]]:
        """(frame, level, directory): directories whose size is the first one's over a power of two are levels of
        the frame before them; full-sized ones begin a new frame; others (labels, thumbnails) are associated pictures."""
        base, out, frame = self.shape(0), [], -1
        for k in range(len(self.directories)):
            s = self.shape(k)
            if not s["reduced"] and (s["width"], s["height"]) == (base["width"], base["height"]):
                frame += 1
                out.append((frame, 0, k))
                continue
            scale = round(base["width"] / s["width"])
            near = scale > 1 and scale & (scale - 1) == 0 and all(abs(s[c] * scale - base[c]) < scale for c in ("width", "height"))
            if near and s["bands"] == base["bands"]:
                out.append((frame, scale.bit_length() - 1, k))
        deepest = max(level for _, level, _ in out)
        return [(f, deepest - level, k) for f, level, k in out]

    def tile(self, f, k: int, index: int) -> tuple[int, int, np.ndarray]:
        """(x, y, pixels) of a stored tile or strip, cut to the picture."""
        t, s = self.directories[k], self.shape(k)
        if t.get(284, (1,))[0] != 1:
            raise ValueError("separate planes aren't read")
        across = -(-s["width"] // s["tile_width"])
        x, y = index % across * s["tile_width"], index // across * s["tile_height"]
        offsets, counts = (324, 325) if s["tiled"] else (273, 279)
        f.seek(t[offsets][index])
        data = f.read(t[counts][index])
        method = t.get(259, (1,))[0]
        if method in (8, 32946):
            data = zlib.decompress(data)
        elif method == 32773:
            data = _packbits(data)
        elif method != 1:
            raise ValueError(f"compression {method} isn't read")
        height = s["tile_height"] if s["tiled"] else min(s["tile_height"], s["height"] - y)
        kind = np.dtype(self.order + s["dtype"])
        pixels = np.frombuffer(data, kind, height * s["tile_width"] * s["bands"]).reshape(height, s["tile_width"], s["bands"])
        if t.get(317, (1,))[0] == 2:
            pixels = np.add.accumulate(pixels, 1, dtype=kind)
        return x, y, np.ascontiguousarray(pixels[: s["height"] - y, : s["width"] - x].astype(kind.newbyteorder("=")))

    def tiles(self, k: int) -> int:
        s = self.shape(k)
        return -(-s["width"] // s["tile_width"]) * -(-s["height"] // s["tile_height"])


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def write_tiff(path: str, levels: list[np.ndarray], tile: int = 256, mm: float | None = None) -> None:
    """A tiled, deflated TIFF; ``levels`` from full size down, each (height, width, bands)."""
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, 0))
        last = 4
        for depth, picture in enumerate(levels):
            height, width, bands = picture.shape
            kind = {"u": 1, "i": 2, "f": 3}[picture.dtype.kind]
            offsets, counts = [], []
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile, bands), picture.dtype.newbyteorder("<"))
                    part = picture[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    data = zlib.compress(block.tobytes())
                    offsets.append(f.tell())
                    counts.append(len(data))
                    f.write(data + b"\0" * (len(data) & 1))
            tags = [(254, 4, [1 if depth else 0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [picture.dtype.itemsize * 8] * bands), (259, 3, [8]), (262, 3, [2 if bands >= 3 else 1]), (277, 3, [bands])]
            if mm:
                tags += [(282, 5, [round(1e4 / (mm * 2**depth)), 1000]), (283, 5, [round(1e4 / (mm * 2**depth)), 1000]), (296, 3, [3])]
            tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts)]
            tags += [(338, 3, [2] * (bands - 3 if bands > 3 else bands - 1))] if bands in (2, 4) else []
            tags.append((339, 3, [kind] * bands))
            entries = []
            for tag, code, values in tags:
                body = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 5: 'I'}[code] }", *values)
                if len(body) > 4:
                    at = f.tell()
                    f.write(body + b"\0" * (len(body) & 1))
                    body = struct.pack("<I", at)
                entries.append(struct.pack("<HHI", tag, code, len(values) // (2 if code == 5 else 1)) + body.ljust(4, b"\0"))
            at = f.tell()
            f.write(struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0))
            end = f.tell()
            f.seek(last)
            f.write(struct.pack("<I", at))
            f.seek(end)
            last = end - 4


#: Readers by name: the suffixes and media types that each opens, best first.
FORMATS = {"png": ((".png",), "image/png"), "tiff": ((".tif", ".tiff", ".ptif", ".svs", ".qptiff"), "image/tiff")}


def can_read(path: str) -> str | None:
    """The reader that opens a file, by its first bytes; None for none."""
    try:
        with open(path, "rb") as f:
            head = f.read(8)
    except OSError:
        return None
    if head == PNG_SIGNATURE:
        return "png"
    return "tiff" if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") else None


class Tiles(InputPartition):
    def __init__(self, path: str, frame: int, level: int, directory: int, first: int, last: int) -> None:
        super().__init__((path, frame, level, directory, first, last))
        self.path, self.frame, self.level, self.directory, self.first, self.last = path, frame, level, directory, first, last


class ImageTiles(DataSource):
    """The tiles of a PNG or TIFF file, or of all in a folder."""

    @classmethod
    def name(cls) -> str:
        return "image_tiles"

    def schema(self) -> str:
        return "path string, frame int, level int, x int, y int, width int, height int, bands int, dtype string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options)


class ImageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.group = options["path"].removeprefix("file:"), int(options.get("tilesPerTask", 64))

    def partitions(self) -> list[InputPartition]:
        root = Path(self.path)
        out: list[InputPartition] = []
        for p in sorted(root.rglob("*")) if root.is_dir() else [root]:
            kind = can_read(str(p)) if p.is_file() else None
            if kind == "png":
                out.append(Tiles(str(p), 0, 0, -1, 0, 1))
            elif kind == "tiff":
                tiff = TiffFile(str(p))
                for frame, level, k in tiff.levels():
                    n = tiff.tiles(k)
                    out += [Tiles(str(p), frame, level, k, i, min(i + self.group, n)) for i in range(0, n, self.group)]
        return out

    def read(self, part: Tiles) -> Iterator[tuple]:
        def row(x, y, pixels):
            return part.path, part.frame, part.level, x, y, pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.dtype.name, pixels.tobytes()

        if part.directory < 0:
            yield row(0, 0, read_png(Path(part.path).read_bytes()))
            return
        tiff = TiffFile(part.path)
        with open(part.path, "rb") as f:
            for index in range(part.first, part.last):
                yield row(*tiff.tile(f, part.directory, index))
