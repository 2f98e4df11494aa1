"""A style document compiled into column expressions over a row of bands.

    {"dtype": "uint8", "bands": [{"band": "r", "palette": ["#000", "#f00"], "min": 40, "max": 200,
      "scheme": "linear", "composite": "lighten", "nodata": 0, "clamp": true}, ...]}

Each entry shades one band by a palette over a range and is laid over the entries before it: ``lighten``
takes the greater of two channels, ``multiply`` their product over 255.  The result is red, green, blue and alpha.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import style as S

#: Palettes by name, as their stops.
NAMED = {"black": ["#000", "#000"], "gray": ["#000", "#fff"], "red": ["#000", "#f00"], "green": ["#000", "#0f0"], "blue": ["#000", "#00f"], "yellow": ["#000", "#ff0"], "cyan": ["#000", "#0ff"], "magenta": ["#000", "#f0f"]}


def stops(palette: str | list) -> list[tuple[int, int, int, int]]:
    """A palette's colours as numbers: a name, one colour, or a list of colours (texts or lists of channels)."""
    if isinstance(palette, str):
        palette = NAMED.get(palette, ["#000", palette])
    out = []
    for colour in palette:
        if isinstance(colour, str):
            body = colour.removeprefix("#")
            body = "".join(2 * c for c in body) if len(body) < 6 else body
            if len(body) not in (6, 8):
                raise ValueError(f"not a colour: {colour}")
            colour = [int(body[k : k + 2], 16) for k in range(0, len(body), 2)]
        out.append(tuple([*colour, 255][:4]))
    return out


def hex_colours(palette: str | list) -> list[str]:
    return ["#" + "".join(f"{c:02x}" for c in colour[: 3 if colour[3] == 255 else 4]) for colour in stops(palette)]


def shaded(value: Column, entry: dict, low: Column | float = 0.0, high: Column | float = 255.0) -> tuple[list[Column], Column]:
    """(channels, drawn) of one entry; ``low`` and ``high`` stand in for "auto"."""
    lo, hi = (entry.get(k, "auto") for k in ("min", "max"))
    lo, hi = (low if lo == "auto" else float(lo)), (high if hi == "auto" else float(hi))
    lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
    v = (value - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)
    drawn = S.visible(value, v, entry.get("nodata"), entry.get("clamp", True) is not False)
    colours = stops(entry.get("palette", "gray"))
    shade = S.discrete if entry.get("scheme") == "discrete" else S.linear
    return [shade(v, [float(c[k]) for c in colours]) for k in range(4)], F.coalesce(drawn, F.lit(False))


def rgba(document: dict, limits: dict[str, tuple] | None = None) -> dict[str, Column]:
    """Columns r, g, b, a of a row that has the bands as columns.  ``limits``: range of a band for "auto"."""
    bands = document.get("bands", [document] if document else [])
    total = [F.lit(0.0)] * 4
    for entry in bands:
        name = str(entry["band"])
        channels, drawn = shaded(F.col(name), entry, *(limits or {}).get(name, (0.0, 255.0)))
        kind = entry.get("composite", "lighten")
        if kind == "multiply":
            mixed = [t * c / 255.0 for t, c in zip(total, channels, strict=True)]
        elif kind == "lighten":
            mixed = [F.greatest(t, c) for t, c in zip(total, channels, strict=True)]
        else:
            raise ValueError(f"unknown composite {kind}")
        total = [F.when(drawn, m).otherwise(t) for m, t in zip(mixed, total, strict=True)]
    kind = document.get("dtype", "uint8")
    scale = {"uint8": 1.0, "uint16": 257.0, "float": 1 / 255.0}[kind]
    out = [t * scale if kind == "float" else F.floor(t * scale).cast("int") for t in total]
    return dict(zip("rgba", out, strict=True))
