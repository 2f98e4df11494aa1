"""Whole-batch byte and word arithmetic in numpy, shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads a 64-bit value over all its bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Powers that are kept for the next call, for each base.
KEPT_POWERS = 1 << 20
#: Bytes of text whose spans are hashed at once.
SPAN_PIECE = 1 << 18
_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, not to be written to; the first ones are computed once a process."""
    if n <= KEPT_POWERS:
        if len(_kept.get(base, ())) < n:
            _kept[base] = _powers(base, min(KEPT_POWERS, max(2 * n, 1 << 16)))
        return _kept[base][:max(n, 1)]
    return _powers(base, n)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, 1 << 64))
        have += step
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span data[start:end]; equal spans, equal hashes.

    A hash doesn't depend on the span's place, so spans in order are hashed some at a time: a very
    long text needs no more memory than the spans of a piece of it.
    """
    out = np.zeros(len(starts), U64)
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out[order] = span_hashes(data, starts[order], ends[order])
        return out
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + SPAN_PIECE, "left")))
        piece = data[low : int(ends[i:j].max())]
        prefix = np.zeros(len(piece) + 1, U64)
        np.cumsum(BYTE_VALUES[piece] * powers(BASE, len(piece)), out=prefix[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        h = (prefix[e] - prefix[s]) * powers(BASE_INV, len(piece) + 1)[s]
        out[i:j] = mix(h ^ (mix((e - s).astype(U64) + U64(1))))
        i = j
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words (runs of bytes that aren't white space)."""
    solid = ~IS_SPACE[data]
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[(offsets >= 0) & (offsets <= len(data))]] = True
    before = np.concatenate(([False], solid[:-1])) & ~cut[:-1]
    after = np.concatenate((solid[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated start, start+1, .. for each start and count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def nearest_smaller(values: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the previous one with a smaller value (-1: none), and the
    least ``link`` on the way, where link[i] joins i-1 and i.

    All positions jump at once over positions that can't be smaller, so a run of
    n values takes about log n rounds.
    """
    n = len(values)
    prev = np.arange(n) - 1
    least = link.copy()
    active = np.flatnonzero(prev >= 0)
    active = active[values[prev[active]] >= values[active]]
    while len(active):
        p = prev[active]
        jump, low = prev[p], np.minimum(least[active], least[p])
        prev[active], least[active] = jump, low
        active = active[jump >= 0]
        active = active[values[prev[active]] >= values[active]]
    least[prev < 0] = 0
    return prev, least
