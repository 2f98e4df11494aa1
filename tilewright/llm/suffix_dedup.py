"""Exact removal of repeated byte strings by longest-previous-factor arrays.

Every byte covered by a string of ``length`` bytes that also starts in a document
with a smaller id goes; the first copy stays.  The suffixes that can match are
found first, then ordered:

1. A string of 50 bytes has one smallest hash among its 20-byte pieces.  Strings
   that are equal share it, so a document sends only its distinct smallest
   hashes (about one for 16 bytes) and learns which of them other texts have.
2. Only the passages around shared hashes go on (``passages``), with their bytes.
   A run of suffixes under one hash, with its bytes, is a context; a context that a
   smaller document has as well is covered as a whole, and a context that is the only
   one of its hash has nothing to lose.
3. The contexts left are dealt by hash into blocks (those of a crowded hash as single
   suffixes by content).  Each block sorts their suffixes (suffix order), takes the
   common prefix of neighbours, and finds for each the previous and next suffix of a
   smaller document; the longer common prefix is its longest previous factor.  At 50
   bytes or more the string goes.

Exact copies of a text are recognised before step 1 and removed as a whole.  So step 3 decides what
neither a whole copy (by SHA-256) nor a context that stands elsewhere as it is (by a 64-bit hash) decides.
Null texts count as empty.  Rows of equal doc_id never remove from one another; repeated rows (equal id and text) are
searched once and get equal results; null ids stand after all others.  Texts shorter than the length stay as they are; an
empty table gives an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tilewright.llm import exchange as X
from tilewright.llm.storage import discard, materialize, release, text_batches
from tilewright.llm.vectors import BASE, BYTE_VALUES, mix, nearest_smaller, ranges, row_slices, span_hashes, utf8

LENGTH = 50
PIECE = 20
SLICE = 3 << 19
KEY48 = np.uint64((1 << 48) - 1)
MARKS = 1 << 20
#: Contexts under one hash from which its suffixes are dealt one by one.
HOT = 20_000

MAPPED = "bucket long, kind int, ids binary, keys binary"
MAPPED_PA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary())])
REPLY = "b2 long, ids binary, keys binary"
REPLY_PA = pa.schema([("b2", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary())])
PASSAGE = "b2 long, uid long, rank long, start long, bytes binary"
PASSAGE_PA = pa.schema([("b2", pa.int64()), ("uid", pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


#: Starts whose pieces are hashed at once, so that the tables of hashes stay small.
PIECE_STARTS = 1 << 17


def smallest_pieces(data: np.ndarray, length: int, piece: int) -> np.ndarray:
    """For each start of a ``length``-byte string the smallest hash of its pieces."""
    n = len(data) - length + 1
    out = np.empty(n, np.uint64)
    for i in range(0, n, PIECE_STARTS):
        j = min(i + PIECE_STARTS, n)
        out[i:j] = _smallest_pieces(data[i : j + length - 1], length, piece)
    return out


def _smallest_pieces(data: np.ndarray, length: int, piece: int) -> np.ndarray:
    m = 1 << 64
    have, width, parts = {1: BYTE_VALUES[data]}, 1, []
    while width * 2 <= piece:
        h = have[width]
        have[width * 2] = h[:-width] * np.uint64(pow(BASE, width, m)) + h[width:]
        width *= 2
    for w in sorted(have, reverse=True):
        if piece & w:
            parts.append(w)
    n = len(data) - piece + 1
    h, done = have[parts[0]][:n].copy(), parts[0]
    for w in parts[1:]:
        h *= np.uint64(pow(BASE, w, m))
        h += have[w][done : done + n]
        done += w
    have.clear()
    h = mix(h)
    window, width = length - piece + 1, 1
    while width * 2 <= window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = window - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """(row, start, suffixes, smallest hash) of each run of string starts that share
    the smallest hash; runs are cut after ``length - piece + 1`` starts."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ranges(offsets[:-1], counts)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    value = smallest_pieces(data, length, piece)[starts]
    change = np.concatenate(([True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)))
    change[(np.cumsum(counts) - counts)[counts > 0]] = True
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(starts)))
    most = length - piece + 1
    pieces = -(-size // most)
    inner = ranges(np.zeros(len(first), np.int64), pieces) * most
    first, size = np.repeat(first, pieces) + inner, np.minimum(np.repeat(size, pieces) - inner, most)
    begin = starts[first]
    return np.searchsorted(offsets, begin, "right") - 1, begin, size, value[first]


def _send(key: np.ndarray, uid: np.ndarray, n: int) -> Iterator[dict]:
    """Step 1, one batch: each key once with its text, or marked as shared (id 0)."""
    order = np.lexsort((uid, key))
    key, uid = key[order], uid[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (uid[1:] != uid[:-1])))
    key, uid = key[fresh], uid[fresh]
    edge = X.group_edges(key)
    many = np.diff(np.append(edge, len(key))) > 1
    sent = np.where(many, 0, uid[edge])
    for b, k, u in X.split_by((mix(key[edge]) % np.uint64(n)).astype(np.int64), key[edge], sent):
        yield {"bucket": b, "kind": 0, "ids": u.tobytes(), "keys": _pack48(k)}
    in_many = np.repeat(many, np.diff(np.append(edge, len(key))))
    for b, k, u in X.split_by(X.row_buckets(uid[in_many], n), key[in_many], uid[in_many]):
        yield {"bucket": b, "kind": 1, "ids": u.tobytes(), "keys": _pack48(k)}


def _pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ask_shared(n: int, length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j in row_slices(offsets, SLICE):
                part = data[offsets[i] : offsets[j]]
                row, _, _, value = runs(part, offsets[i : j + 1] - offsets[i], length, piece)
                if len(row):
                    yield X.blobs(list(_send(value & KEY48, uid[i:j][row], n)), MAPPED_PA)

    return run


def _answer_shared(n: int):
    """A key that two texts have goes back to all of them."""

    def run(table: pa.Table) -> pa.Table:
        out = [{"b2": r["bucket"], "ids": r["ids"], "keys": r["keys"]} for r in table.filter(pc.equal(table["kind"], 1)).to_pylist()]
        asked = table.filter(pc.equal(table["kind"], 0))
        if len(asked):
            key = _unpack48(b"".join(asked["keys"].to_pylist()))
            uid = np.frombuffer(b"".join(asked["ids"].to_pylist()), np.int64)
            order = np.argsort(key, kind="stable")
            key, uid = key[order], uid[order]
            edge = X.group_edges(key)
            size = np.diff(np.append(edge, len(key)))
            shared = np.minimum.reduceat(uid, edge) != np.maximum.reduceat(uid, edge)
            back = np.repeat(shared, size) & (uid != 0)
            for b, k, u in X.split_by(X.row_buckets(uid[back], n), key[back], uid[back]):
                out.append({"b2": b, "ids": u.tobytes(), "keys": _pack48(k)})
        return pa.Table.from_pylist(out, schema=REPLY_PA)

    return run


def _passages(length: int, piece: int):
    """The passages of each document around keys that other texts have."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs) or not len(replies):
            return PASSAGE_PA.empty_table()
        ids = np.frombuffer(b"".join(replies["ids"].to_pylist()), np.int64)
        keys = _unpack48(b"".join(replies["keys"].to_pylist()))
        asked = np.unique(ids)
        pair = np.unique(mix(ids.view(np.uint64)) ^ mix(keys + np.uint64(1)))
        docs = docs.filter(pc.is_in(docs["uid"], value_set=pa.array(asked)))
        out = []
        data, offsets = utf8(docs["text"])
        uid, rank, b2 = (docs[c].to_numpy() for c in ("uid", "rank", "b2"))
        for i, j in row_slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            row, start, size, value = runs(part, own, length, piece)
            if not len(row):
                continue
            probe = mix(uid[i:j][row].view(np.uint64)) ^ mix((value & KEY48) + np.uint64(1))
            at = np.minimum(np.searchsorted(pair, probe), len(pair) - 1)
            hit = pair[at] == probe
            row, start, end = row[hit], start[hit], (start + size + length - 1)[hit]
            if not len(row):
                continue
            fresh = np.concatenate(([True], (start[1:] > end[:-1]) | (row[1:] != row[:-1])))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(row)) - 1
            for r, s, e in zip(row[first], start[first], end[last], strict=True):
                out.append({"b2": b2[i + r], "uid": uid[i + r], "rank": rank[i + r], "start": s - own[r], "bytes": part[s:e].tobytes()})
        return pa.Table.from_pylist(out, schema=PASSAGE_PA)

    return run


def _contexts(data, offsets, length, piece):
    row, start, size, value = runs(data, offsets, length, piece)
    if not len(row):
        return row, start, size, value, value
    return row, start, size, value, mix(value ^ span_hashes(data, start, start + size + length - 1))


def _mixed_key(value: np.ndarray) -> np.ndarray:
    """Key of the question whether a smallest hash has more than one context."""
    return mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _ask_contexts(n: int, length: int, piece: int):
    """Step 2: each context once for a batch, with the smallest document (kind 0), and
    each smallest hash once, with that context or marked as mixed (kind 2)."""

    def ask(row, value, key, uid, rank) -> Iterator[dict]:
        u, r, v = uid[row], rank[row], _mixed_key(value)
        order = np.lexsort((r, key))
        key, u, r, v = key[order], u[order], r[order], v[order]
        edge = X.group_edges(key)
        size = np.diff(np.append(edge, len(key)))
        later = r > np.repeat(r[edge], size)
        for b, ks, us in X.split_by(X.row_buckets(u, n)[later], key[later], u[later]):
            yield {"bucket": b, "kind": 1, "ids": us.tobytes(), "keys": ks.tobytes()}
        key, u, r, v = key[~later], u[~later], r[~later], v[~later]
        for b, ks, us, rs in X.split_by((key % np.uint64(n)).astype(np.int64), key, u, r):
            yield {"bucket": b, "kind": 0, "ids": np.stack((us, rs), 1).tobytes(), "keys": ks.tobytes()}
        order = np.lexsort((u, key, v))
        key, u, v = key[order], u[order], v[order]
        edge = X.group_edges(v)
        size = np.diff(np.append(edge, len(v)))
        mixed = np.minimum.reduceat(key, edge) != np.maximum.reduceat(key, edge)
        told = np.repeat(mixed, size)
        for b, vs, us in X.split_by(X.row_buckets(u, n)[told], v[told], u[told]):
            yield {"bucket": b, "kind": 1, "ids": us.tobytes(), "keys": vs.tobytes()}
        # One document of the smallest rank stands for the batch; more of equal rank go too.
        sent = ~told
        sent[edge[mixed]] = True
        # A mark carries the number of contexts; context keys are hashes, far above MARKS.
        c = np.where(told, np.minimum(np.repeat(size, size), MARKS - 1).astype(np.uint64), key)[sent]
        for b, vs, us, cs in X.split_by((v[sent] % np.uint64(n)).astype(np.int64), v[sent], u[sent].view(np.uint64), c):
            yield {"bucket": b, "kind": 2, "ids": np.stack((us, cs), 1).tobytes(), "keys": vs.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("bytes"))
            uid, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "rank"))
            for i, j in row_slices(offsets, SLICE):
                row, _, _, value, key = _contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, piece)
                if len(row):
                    yield X.blobs(list(ask(row, value, key, uid[i:j], rank[i:j])), MAPPED_PA)

    return run


def _answer_contexts(n: int, hot: int):
    """A context goes back to every document that isn't the first to have it, and a mixed
    hash to every document that asked about it; hashes with ``hot`` contexts are named."""

    def run(table: pa.Table) -> pa.Table:
        out = [{"b2": r["bucket"], "ids": r["ids"], "keys": r["keys"]} for r in table.filter(pc.equal(table["kind"], 1)).to_pylist()]
        asked = table.filter(pc.equal(table["kind"], 0))
        if len(asked):
            key = np.frombuffer(b"".join(asked["keys"].to_pylist()), np.uint64)
            u, r = np.frombuffer(b"".join(asked["ids"].to_pylist()), np.int64).reshape(-1, 2).T
            order = np.lexsort((r, key))
            key, u, r = key[order], u[order], r[order]
            edge = X.group_edges(key)
            later = r > np.repeat(r[edge], np.diff(np.append(edge, len(key))))
            for b, k, us in X.split_by(X.row_buckets(u[later], n), key[later], u[later]):
                out.append({"b2": b, "ids": us.tobytes(), "keys": k.tobytes()})
        asked = table.filter(pc.equal(table["kind"], 2))
        if len(asked):
            v = np.frombuffer(b"".join(asked["keys"].to_pylist()), np.uint64)
            u, c = np.frombuffer(b"".join(asked["ids"].to_pylist()), np.uint64).reshape(-1, 2).T
            order = np.argsort(v, kind="stable")
            v, u, c = v[order], u[order].view(np.int64), c[order]
            edge = X.group_edges(v)
            mixed = np.minimum.reduceat(c, edge) != np.maximum.reduceat(c, edge)
            mark = c < MARKS
            told = np.repeat(mixed | np.logical_or.reduceat(mark, edge), np.diff(np.append(edge, len(v)))) & ~mark
            crowd = v[edge][np.add.reduceat(np.where(mark, c, 1).astype(np.int64), edge) >= hot]
            if len(crowd):
                out.append({"b2": -1, "ids": b"", "keys": crowd.tobytes()})
            for b, k, us in X.split_by(X.row_buckets(u[told], n), v[told], u[told]):
                out.append({"b2": b, "ids": us.tobytes(), "keys": k.tobytes()})
        return pa.Table.from_pylist(out, schema=REPLY_PA)

    return run


SUFFIX = "bucket long, kind int, ids binary, spans binary, suffixes binary"
SUFFIX_PA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("spans", pa.binary()), ("suffixes", pa.binary())])
SPANS = "b2 long, ids binary, spans binary"
SPANS_PA = pa.schema([("b2", pa.int64()), ("ids", pa.binary()), ("spans", pa.binary())])


def _suffixes(n: int, length: int, piece: int, crowded: np.ndarray):
    """Spans that step 2 settled (kind 1), and the contexts it left (kind 0).

    Contexts of one hash meet in one block; those of a crowded hash go as single suffixes,
    by content, each once for a batch.
    """

    def run(passages: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if not len(passages):
            return SUFFIX_PA.empty_table()
        ids = np.frombuffer(b"".join(replies["ids"].to_pylist()), np.int64)
        keys = np.frombuffer(b"".join(replies["keys"].to_pylist()), np.uint64)
        pair = np.unique(mix(ids.view(np.uint64)) ^ keys) if len(ids) else np.zeros(1, np.uint64)
        data, offsets = utf8(passages["bytes"])
        uid, rank, at = (passages[c].to_numpy() for c in ("uid", "rank", "start"))
        for i, j in row_slices(offsets, SLICE):
            own = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            row, start, size, value, key = _contexts(part, own, length, piece)
            if not len(row):
                continue
            u, r, shift = uid[i:j][row], rank[i:j][row], at[i:j][row] - own[row]
            probe = mix(u.view(np.uint64)) ^ key
            hit = pair[np.minimum(np.searchsorted(pair, probe), len(pair) - 1)] == probe
            for b, us, ss, ls in X.split_by(X.row_buckets(u[hit], n), u[hit], (start + shift)[hit], (size + length - 1)[hit]):
                out.append({"bucket": b, "kind": 1, "ids": us.tobytes(), "spans": np.stack((ss, ls), 1).tobytes()})
            # A context that is the only one of its hash holds no string of another.
            probe = mix(u.view(np.uint64)) ^ _mixed_key(value)
            left = ~hit & (pair[np.minimum(np.searchsorted(pair, probe), len(pair) - 1)] == probe)
            row, start, size, u, r, shift = (x[left] for x in (row, start, size, u, r, shift))
            home = _mixed_key(value[left])
            many = np.isin(home, crowded)
            for b, us, rs, bs, ss, zs in X.split_by((home % np.uint64(n)).astype(np.int64)[~many], u[~many], r[~many], start[~many], shift[~many], size[~many]):
                out.append({"bucket": b, "kind": 0, "ids": np.stack((us, rs), 1).tobytes(), "spans": np.stack((bs + ss, zs), 1).tobytes(), "suffixes": part[ranges(bs, zs + length - 1)].tobytes()})
            row, start, size, u, r, shift = (x[many] for x in (row, start, size, u, r, shift))
            begin = ranges(start, size)
            u, r, shift = np.repeat(u, size), np.repeat(r, size), np.repeat(shift, size)
            if not len(begin):
                continue
            h = span_hashes(part, begin, begin + length)
            order = np.lexsort((r, h))
            h, begin, u, r, shift = (x[order] for x in (h, begin, u, r, shift))
            edge = X.group_edges(h)
            later = r > np.repeat(r[edge], np.diff(np.append(edge, len(h))))
            for b, us, ss in X.split_by(X.row_buckets(u[later], n), u[later], (begin + shift)[later]):
                out.append({"bucket": b, "kind": 1, "ids": us.tobytes(), "spans": np.stack((ss, np.full(len(ss), length)), 1).tobytes()})
            h, begin, u, r, shift = (x[~later] for x in (h, begin, u, r, shift))
            grams = np.lib.stride_tricks.sliding_window_view(part, length)
            for b, us, rs, bs, ss in X.split_by((h % np.uint64(n)).astype(np.int64), u, r, begin, begin + shift):
                out.append({"bucket": b, "kind": 0, "ids": np.stack((us, rs), 1).tobytes(), "spans": np.stack((ss, np.ones_like(ss)), 1).tobytes(), "suffixes": grams[bs].tobytes()})
        return pa.Table.from_pylist(out, schema=SUFFIX_PA)

    return run


def previous_factors(suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: the longest prefix, up to the width of
    the rows, that a suffix of a smaller rank has as well."""
    n, width = suffixes.shape
    pad = -width % 8
    wide = np.zeros((n, width + pad), np.uint8)
    wide[:, :width] = suffixes
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    rows = suffixes[order]
    differ = rows[1:] != rows[:-1]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    value = rank[order]
    before = nearest_smaller(value, common)[1]
    back = np.zeros(n, np.int64)
    back[1:] = common[:0:-1]
    after = nearest_smaller(value[::-1].copy(), back)[1][::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _match(n: int, length: int):
    """Step 3: the blocks of suffixes."""

    def run(table: pa.Table) -> pa.Table:
        out = [{"b2": r["bucket"], "ids": r["ids"], "spans": r["spans"]} for r in table.filter(pc.equal(table["kind"], 1)).to_pylist()]
        asked = table.filter(pc.equal(table["kind"], 0))
        if len(asked):
            u, r = np.frombuffer(b"".join(asked["ids"].to_pylist()), np.int64).reshape(-1, 2).T
            s, size = np.frombuffer(b"".join(asked["spans"].to_pylist()), np.int64).reshape(-1, 2).T
            data = np.frombuffer(b"".join(asked["suffixes"].to_pylist()), np.uint8)
            grown = size + length - 1
            begin = ranges(np.cumsum(grown) - grown, size)
            s, u, r = ranges(s, size), np.repeat(u, size), np.repeat(r, size)
            rows = np.lib.stride_tricks.sliding_window_view(data, length)[begin]
            gone = previous_factors(rows, r) >= length
            for b, us, ss in X.split_by(X.row_buckets(u[gone], n), u[gone], s[gone]):
                out.append({"b2": b, "ids": us.tobytes(), "spans": np.stack((ss, np.full(len(ss), length)), 1).tobytes()})
        return pa.Table.from_pylist(out, schema=SPANS_PA)

    return run


def _whole(n: int):
    """A span over the whole of each later copy of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, size = (batch.column(c).to_numpy() for c in ("uid", "n_bytes"))
            out = [{"b2": b, "ids": us.tobytes(), "spans": np.stack((np.zeros_like(ls), ls), 1).tobytes()} for b, us, ls in X.split_by(X.row_buckets(u, n), u, size)]
            yield X.blobs(out, SPANS_PA)

    return run


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans of each owner, in order."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    edge = X.group_edges(owner)
    # Running maximum of the ends within an owner: lift each owner's ends above all before.
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(owner))))
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], reach[last]


def _apply(names: list[str], schema: pa.Schema, keep_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        uid = docs["uid"].to_numpy()
        ids = np.frombuffer(b"".join(spans["ids"].to_pylist()), np.int64)
        se = np.frombuffer(b"".join(spans["spans"].to_pylist()), np.int64).reshape(-1, 2)
        owner, start, end = merge_spans(ids, se[:, 0], se[:, 0] + se[:, 1])
        lo, hi = np.searchsorted(owner, uid, "left"), np.searchsorted(owner, uid, "right")
        n_bytes, removed, n_spans, sha, kept = [], [], [], [], []
        for text, a, b in zip(docs["text"].cast(pa.binary()).to_pylist(), lo, hi, strict=True):
            text = text or b""
            parts, at = [], 0
            for s, e in zip(start[a:b], end[a:b], strict=True):
                parts.append(text[at:s])
                at = e
            left = b"".join((*parts, text[at:])) if b > a else text
            n_bytes.append(len(text))
            removed.append(len(text) - len(left))
            n_spans.append(int(b - a))
            sha.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                kept.append(left.decode("utf-8", "ignore"))
        out = {"n_bytes": n_bytes, "n_removed": removed, "n_spans": n_spans, "kept_sha256": sha} | ({"kept": kept} if keep_text else {})
        return pa.table([docs[c].cast(schema.field(c).type) if c in names else pa.array(out[c], schema.field(c).type) for c in schema.names], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, piece: int = PIECE, keep_text: bool = False, hot: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_text`` also ``kept``, the remaining text (bytes of a character cut in
    two are left out), and ``row``, the row's other columns as a struct.
    """
    n = X.bucket_count(docs, text_col)
    hot = hot or max(HOT, n * X.BUCKET_BYTES // 2_000_000)
    kept_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if keep_text else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(int(X.LAST))).cast("long").alias("rank"), F.col(text_col).alias("text"), *kept_row)
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    base = base.withColumn("uid", F.xxhash64("rank", F.coalesce("text", F.lit(""))))
    ids = materialize(base.select("rank", "uid", sha.alias("sha"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "ids")
    # Written before it is joined: Spark then splits a text that much of all rows copy.
    first = materialize(ids.groupBy("sha").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "first")
    copies = materialize(ids.join(first, "sha").where((F.col("rank") > F.col("first")) & (F.col("n_bytes") >= length)).select("uid", "n_bytes").distinct(), "copies")
    again = materialize(ids.groupBy("uid").count().where("count > 1").select("uid"), "again")
    rows = base.withColumn("b2", X.row_bucket_column("uid", n))

    alone = X.once(rows.where(F.octet_length("text") >= length).join(copies.select("uid"), "uid", "left_anti").select("b2", "uid", "rank", "text"), again)
    with text_batches(docs.sparkSession):
        shared = materialize(alone.select("uid", "text").mapInArrow(_ask_shared(n, length, piece), MAPPED).groupBy("bucket").applyInArrow(_answer_shared(n), REPLY), "shared", large=True)
    passages = materialize(
        alone.groupBy("b2").cogroup(shared.groupBy("b2")).applyInArrow(_passages(length, piece), PASSAGE), "passages", large=True
    )
    discard(shared)
    known = materialize(passages.mapInArrow(_ask_contexts(n, length, piece), MAPPED).groupBy("bucket").applyInArrow(_answer_contexts(n, hot), REPLY), "contexts", large=True)
    # Their number is bound: every one has ``hot`` of at most total / 16 contexts.
    crowded = np.array([k for row in known.where("b2 = -1").collect() for k in np.frombuffer(row["keys"], np.uint64)], np.uint64)
    known = known.where("b2 >= 0")
    suffixes = passages.groupBy("b2").cogroup(known.groupBy("b2")).applyInArrow(_suffixes(n, length, piece, crowded), SUFFIX)
    spans = materialize(suffixes.groupBy("bucket").applyInArrow(_match(n, length), SPANS).unionByName(copies.mapInArrow(_whole(n), SPANS)), "spans")
    discard(passages)
    discard(known)
    release(docs.sparkSession)
    kept = ["kept"] if keep_text else []
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string"}
    source = rows.select("b2", "doc_id", "uid", "text", *(["row"] if keep_text else []))

    def applied(source: DataFrame, own: list[str]) -> DataFrame:
        result = StructType([source.schema[c] if c in source.columns else StructType.fromDDL(f"{c} {types[c]}")[0] for c in (*own, *fields, *kept)])
        # What comes back from Python may be null anywhere.
        result = StructType.fromJson(json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)"):false', r"\1:true", result.json())))
        return source.groupBy("b2").cogroup(spans.groupBy("b2")).applyInArrow(_apply(source.columns, to_arrow_schema(result), keep_text), result)

    own = ["doc_id"] + (["row"] if keep_text else [])
    several = source.join(again, "uid", "left_semi")
    one = several.groupBy("uid").agg(F.first("b2").alias("b2"), F.first("text").alias("text"))
    several = several.select("uid", *own).join(applied(one, ["uid"]), "uid")
    columns = ["doc_id", *fields, *(["row", "kept"] if keep_text else [])]
    return applied(source.join(again, "uid", "left_anti"), own).select(*columns).unionByName(several.select(*columns))
