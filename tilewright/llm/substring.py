"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles (words lower-cased in A-Z).  Under one hash
function, the Cartesian tree over the hashes groups all passages by the shingle that is
their minimum: a compact window (l, c, r) stands for every passage that starts in
[l, c] and ends in [c, r].  Windows that hold a passage of 46 shingles (50 words) are kept,
about two for 46 shingles.

1. Each text sends its window keys under eight hash functions, and learns which of
   them other texts have (one entry for each batch and key, as in the suffix search).
2. Where the windows of at least four functions with shared keys hold a common passage (an interval
   join over its starts), that region goes on.
3. The holders of a key, over the whole corpus, fall into classes of equal surroundings (the 45 shingles on
   both sides, all that a passage with the key can hold).  Up to ``CLASSES`` classes, the first region of each
   is named as a partner to every later holder; a key with more is crowded.
4. A region and a partner are candidates if four functions name it, where a key that is crowded or stands for more
   holders than it names counts as well.  Candidates are compared on their shingles: passages of 50
   words are near-duplicates if their shingles overlap by 0.8 or more (Jaccard, of multisets).
   This is done in two turns.  First a region is compared with two partners, the earliest and the one of the longest
   common stretch; then with the others, but for those of its own component by now that could only show again what it is already
   known to share (every place where a key names them).  Of these, pairs whose 16-bit sketches of shingles rule a shared
   passage out are not sent to be compared.  So a group of n copies of a text, edited here and there,
   takes some 2 n comparisons; no two components that a candidate would join stay apart, and no passage is missed.
5. Under crowded keys every passage of 50 words is looked up by the hash of its content, so that
   its repeats are found however many there are; edited ones are compared with the ``LEADERS`` first regions
   and with the partners that their other keys name.
6. What is left is pairs whose keys are crowded under every function that agrees.  Stretches with four crowded
   functions are joined without a bound, by prefixes: near-duplicates differ in five of 46 shingles at most, so one of
   the six rarest of each passage stands in the partner as well; the n-th time of a shingle counts as one of its own, so that a run of one
   word only meets runs as long.  Each of these is compared with the first stretch of every class
   that holds it; of its own component, where it is known to be shared already, with the first one only.

So exact repeats of 50 words are all found; a near-duplicate is missed only if the hashes of fewer than four
functions agree.

Copies of a whole text are linked to the first one directly.  Chains of links make the
components.  Null texts are empty and have no links; texts of less than 50 words have no passages and are linked to their copies only;
rows of equal id never match each other, and repeated rows are searched once; null ids stand last and take no id;
an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import exchange as X
from tilewright.llm.components import connect, smallest_of_component
from tilewright.llm.storage import bucketed, discard, materialize, release
from tilewright.llm.suffix_dedup import KEY48, MAPPED, MAPPED_PA, REPLY, _answer_shared, _send, merge_spans
from tilewright.llm.vectors import BASE, BASE_INV, LOWER, mix, powers, ranges, row_slices, span_hashes, utf8, word_spans

SHINGLE = 5
PASSAGE_WORDS = 50
LEAST = PASSAGE_WORDS - SHINGLE + 1
FUNCTIONS = 8
ENOUGH = 4
SIMILARITY = 0.8
#: Classes of surroundings that a key may have before it is crowded, and the regions it then names.
CLASSES = 64
LEADERS = 8
SLICE = 2 << 20
#: Shingles whose windows are found at once, so that the tables stay in a core's cache.
WINDOW_SLICE = 1 << 15
SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the shingles of each row of lower-cased bytes."""
    starts, ends, rows = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    words = np.bincount(rows, minlength=n)
    counts = np.maximum(words - SHINGLE + 1, 0)
    first = np.cumsum(words) - words
    at = ranges(first, counts)
    total = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        total = total * np.uint64(BASE) + (h[at + j] if len(at) else total)
    return mix(total), np.concatenate(([0], np.cumsum(counts)))


def window_starts(offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last ``least`` - 1 of all rows: whether a stretch of its row starts there, and whether it is the row's first."""
    n = max(0, int(offsets[-1]) - least + 1)
    long = np.diff(offsets) >= least
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[:-1][long]] = 1
    edge[offsets[1:][long] - least + 1] -= 1
    first = np.zeros(n, bool)
    first[offsets[:-1][long]] = True
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool), first


def compact_windows(h: np.ndarray, offsets: np.ndarray, least: int = LEAST, reach: int | None = None, starts: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes of at least ``least`` hashes, a tree for each row.

    Nodes that wide are the minima of stretches of ``least`` hashes.  Their ends are found by binary
    descent over tables of minima of 1, 2, 4, .. hashes; with ``reach`` at least that far from c.
    """
    none = np.zeros(0, np.int64)
    inside, first = window_starts(offsets, least) if starts is None else starts
    if not inside.any():
        return none, none, none
    bits = np.uint64(max(20, len(h).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    u = (h >> bits << bits) | place  # the position makes values distinct: the first of equals wins
    longest = max(least, int(np.diff(offsets).max()) if reach is None else reach)
    tables = [u]
    while 1 << len(tables) <= longest:
        half = 1 << (len(tables) - 1)
        last = tables[-1]
        if len(last) <= half:
            break
        tables.append(np.minimum(last[:-half], last[half:]))
    p = least.bit_length() - 1
    n = len(inside)
    low = np.minimum(tables[p][:n], tables[p][least - (1 << p) :][:n])
    new = first.copy()
    new[1:] |= low[1:] != low[:-1]  # the place of a sliding minimum never goes back
    c = (low[new & inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offsets, c, "right") - 1
    l, r = c.copy(), c.copy()
    for p in range(len(tables) - 1, -1, -1):
        w, t = 1 << p, tables[p]
        go = l - w >= offsets[row]
        go[go] = t[l[go] - w] > u[c[go]]
        l[go] -= w
        go = r + w < offsets[row + 1]
        go[go] = t[r[go] + 1] > u[c[go]]
        r[go] += w
    return l, c, r


def start_intervals(l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the passages of ``least`` hashes that a window holds."""
    return np.maximum(l, c - least + 1), np.minimum(c, r - least + 1)


def keyed_windows(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, function, row, first start, last start, place of the minimum) of all windows of all functions."""
    out = []
    for i, j in row_slices(offsets, WINDOW_SLICE):
        base, part = offsets[i], h[offsets[i] : offsets[j]]
        own = offsets[i : j + 1] - base
        starts = window_starts(own, LEAST)
        for k, seed in enumerate(SEEDS):
            v = (part ^ seed) * (seed | np.uint64(1))  # h is mixed already
            l, c, r = compact_windows(v, own, LEAST, LEAST, starts)
            a, b = start_intervals(l, c, r)
            out.append((mix(v[c] + np.uint64(k)) & KEY48, np.full(len(c), k), i + np.searchsorted(own, c, "right") - 1, a + base, b + base, c + base))
    if not out:
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), *[none] * 5)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def stretch_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch h[start:stop] of shingles."""
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=prefix[1:])
    return mix((prefix[stop] - prefix[start]) * powers(BASE_INV, len(h) + 1)[start] ^ mix((stop - start).astype(np.uint64)))


def covered_runs(owner: np.ndarray, function: np.ndarray, first: np.ndarray, last: np.ndarray, enough: int = ENOUGH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the maximal runs of starts that the intervals of ``enough``
    functions hold, by a sweep over the intervals' ends.  Intervals of one function are
    disjoint for one owner, unless the owner repeats a key; those are merged first."""
    if not len(owner):
        return owner, first, last
    names, index = np.unique(owner, return_inverse=True)
    lane, s, e = merge_spans(index * FUNCTIONS + function, first, last + 1)
    who = lane // FUNCTIONS
    at = np.concatenate((s, e))
    who2 = np.concatenate((who, who))
    step = np.concatenate((np.ones(len(s), np.int64), -np.ones(len(e), np.int64)))
    order = np.lexsort((step, at, who2))
    at, who2, step = at[order], who2[order], step[order]
    depth = np.cumsum(step)
    deep = depth >= enough
    begin = np.flatnonzero(deep & ~np.concatenate(([False], deep[:-1])))
    end = np.flatnonzero(~deep & np.concatenate(([False], deep[:-1])))
    return names[who2[begin]], at[begin], at[end] - 1


def _ask(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j in row_slices(offsets, SLICE):
                h, so = shingles(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                key, _, row, *_ = keyed_windows(h, so)
                if len(key):
                    yield X.blobs(list(_send(key, uid[i:j][row], n)), MAPPED_PA)

    return run


#: ``sketch`` is the low 16 bits of each shingle.
REGIONS = "b2 long, uid long, rank long, start long, shingles binary, sketch binary"
REGIONS_PA = pa.schema([("b2", pa.int64()), ("uid", pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.binary())])


def _regions(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """The regions of each text that windows with shared keys point to."""
    if not len(docs) or not len(replies):
        return REGIONS_PA.empty_table()
    ids = np.frombuffer(b"".join(replies["ids"].to_pylist()), np.int64)
    raw = np.frombuffer(b"".join(replies["keys"].to_pylist()), np.uint8).reshape(-1, 6)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :6] = raw
    pair = np.unique(mix(ids.view(np.uint64)) ^ mix(keys.view("<u8").ravel() + np.uint64(1)))
    docs = docs.filter(pc.is_in(docs["uid"], value_set=pa.array(np.unique(ids))))
    data, offsets = utf8(docs["text"])
    uid, rank, b2 = (docs[c].to_numpy() for c in ("uid", "rank", "b2"))
    out = []
    for i, j in row_slices(offsets, SLICE):
        h, so = shingles(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
        key, function, row, a, b, _ = keyed_windows(h, so)
        if not len(key):
            continue
        probe = mix(uid[i:j][row].view(np.uint64)) ^ mix(key + np.uint64(1))
        hit = pair[np.minimum(np.searchsorted(pair, probe), len(pair) - 1)] == probe
        who, s, e = covered_runs(row[hit], function[hit], a[hit], b[hit])
        # Runs whose passages touch are one region.
        who, s, e = merge_spans(who, s, e + LEAST)
        for r, x, y in zip(who.tolist(), s.tolist(), e.tolist(), strict=True):
            out.append({"b2": b2[i + r], "uid": uid[i + r], "rank": rank[i + r], "start": x - so[r], "shingles": h[x:y].tobytes(), "sketch": h[x:y].astype(np.uint16).tobytes()})
    return pa.Table.from_pylist(out, schema=REGIONS_PA)


HELD = "bucket long, kind int, keys binary, classes binary, ids binary"
HELD_PA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary()), ("ids", pa.binary())])
FIRST_OF_CLASS, ASKS = 0, 1
GROUPS = "b2 long, keys binary, sizes binary, hides binary, members binary"
GROUPS_PA = pa.schema([("b2", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("hides", pa.binary()), ("members", pa.binary())])
#: What a key hides: nothing, other holders of a class it names, or other classes.
NONE, COPIES, CROWD = 0, 1, 2
#: Entries that are expanded at once.
STEP = 2 << 20
#: The longest window that may be a near-duplicate of a passage, in shingles.
REACH = int(LEAST / SIMILARITY + 1e-9)
#: Cells in which the tokens of crowded stretches are counted, and the parts these travel in.
CELLS, CELL_PARTS = 1 << 18, 16
#: Pairs of crowded stretches that are expanded at once.
PAIR_STEP = 1 << 18
#: Passages whose rarest tokens are chosen at once, of 46 numbers in some ten tables.
PASSAGE_STEP = 1 << 12


def _region_windows(regions) -> tuple[np.ndarray, ...]:
    h = np.frombuffer(b"".join(regions.column("shingles").to_pylist()), np.uint64)
    size = np.array([len(x) // 8 for x in regions.column("shingles").to_pylist()], np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return (h, offsets, *keyed_windows(h, offsets))


def _first_classes(key: np.ndarray, cls: np.ndarray, ids: np.ndarray, many: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each key the first holder of each class, ``most`` + 1 classes at most, in order of
    key and rank; with whether the class has more than one holder."""
    order = np.lexsort((ids[:, 2], ids[:, 0], ids[:, 1], cls, key))
    key, cls, ids, many = key[order], cls[order], ids[order], many[order]
    edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    many = np.logical_or.reduceat(many, edge) | (size > 1) if len(edge) else many
    key, cls, ids = key[edge], cls[edge], ids[edge]
    order = np.lexsort((ids[:, 0], ids[:, 1], key))
    key, cls, ids, many = key[order], cls[order], ids[order], many[order]
    edge = X.group_edges(key)
    place = np.arange(len(key)) - np.repeat(edge, np.diff(np.append(edge, len(key))))
    keep = place <= most
    return key[keep], cls[keep], ids[keep], many[keep]


def _held_keys(n: int, most: int = CLASSES):
    """Sends the classes of every key of a batch's regions to the key's bucket, with the row buckets that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("shingles").to_pylist()], np.int64)
            for at, stop in row_slices(np.concatenate(([0], np.cumsum(sizes))), 4 << 20):
                part = batch.slice(at, stop - at)
                h, offsets, key, _, row, _, _, c = _region_windows(part)
                if not len(key):
                    continue
                cls = stretch_hashes(h, np.maximum(offsets[row], c - LEAST + 1), np.minimum(offsets[row + 1], c + LEAST))
                ids = np.stack([part.column(k).to_numpy(zero_copy_only=False)[row] for k in ("uid", "rank", "start")], 1)
                home = (mix(key) % np.uint64(n)).astype(np.int64)
                order = np.lexsort((ids[:, 1], X.row_buckets(np.ascontiguousarray(ids[:, 0]), n), key))
                b2 = X.row_buckets(np.ascontiguousarray(ids[:, 0]), n)[order]
                last = np.concatenate(((key[order][1:] != key[order][:-1]) | (b2[1:] != b2[:-1]), [True]))
                asks = np.stack((b2[last], ids[order[last], 1]), 1)
                out = [{"bucket": b, "kind": ASKS, "keys": k.tobytes(), "ids": i.tobytes()} for b, k, i in X.split_by(home[order[last]], key[order[last]], asks)]
                key, cls, ids, many = _first_classes(key, cls, ids, np.zeros(len(key), bool), most)
                home = (mix(key) % np.uint64(n)).astype(np.int64)
                own = np.concatenate((ids, many[:, None].astype(np.int64)), 1)
                out += [{"bucket": b, "kind": FIRST_OF_CLASS, "keys": k.tobytes(), "classes": s.tobytes(), "ids": i.tobytes()} for b, k, s, i in X.split_by(home, key, cls, own)]
                yield X.blobs(out, HELD_PA)

    return run


def _group_members(most: int = CLASSES, leaders: int = LEADERS):
    """The partners that a key names, sent once to each row bucket that has a later document with it.  What
    a crowded key doesn't name is left to the join of crowded stretches."""

    def run(table: pa.Table) -> pa.Table:
        first, asks = (table.filter(pc.equal(table["kind"], k)) for k in (FIRST_OF_CLASS, ASKS))
        key, cls = (np.frombuffer(b"".join(first[c].to_pylist()), np.uint64) for c in ("keys", "classes"))
        ids = np.frombuffer(b"".join(first["ids"].to_pylist()), np.int64).reshape(-1, 4)
        key, cls, ids, many = _first_classes(key, cls, ids[:, :3], ids[:, 3] > 0, most)
        edge = X.group_edges(key)
        size = np.diff(np.append(edge, len(key)))
        hides = np.where(size > most, CROWD, np.where(np.logical_or.reduceat(many, edge), COPIES, NONE)) if len(edge) else size
        size = np.where(size > most, leaders, size)
        asked = np.frombuffer(b"".join(asks["keys"].to_pylist()), np.uint64)
        home, rank = np.frombuffer(b"".join(asks["ids"].to_pylist()), np.int64).reshape(-1, 2).T
        order = np.lexsort((rank, home, asked))
        asked, home, rank = asked[order], home[order], rank[order]
        last = np.concatenate(((asked[1:] != asked[:-1]) | (home[1:] != home[:-1]), [True])) if len(asked) else np.zeros(0, bool)
        asked, home, rank = asked[last], home[last], rank[last]
        group = np.searchsorted(key[edge], asked)
        # A crowded key is told to all its holders, as the first ones are partners in the crowd too.
        ask = (rank > ids[edge[group], 1]) | (hides[group] == CROWD) if len(asked) else last
        home, group = home[ask], group[ask]
        out = []
        total = np.cumsum(size[group])
        begin = 0
        while begin < len(group):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP, "right")))
            for b, g in X.split_by(home[begin:stop], group[begin:stop]):
                out.append({"b2": b, "keys": key[edge[g]].tobytes(), "sizes": size[g].tobytes(), "hides": hides[g].tobytes(), "members": ids[ranges(edge[g], size[g])].tobytes()})
            begin = stop
        return pa.Table.from_pylist(out, schema=GROUPS_PA)

    return run


CANDIDATES = "kind int, b2 long, puid long, pstart long, asks binary"
CANDIDATES_PA = pa.schema([("kind", pa.int32()), ("b2", pa.int64()), ("puid", pa.int64()), ("pstart", pa.int64()), ("asks", pa.binary())])
#: A partner's asks, passages to look up by content (hash, uid, rank, place), ones that are found (uid, place, partner, its
#: rank), and pairs for the second turn (uid, start, first, last, first and last place that must be shared, partner, its start).
COMPARE, LOOK_UP, FOUND_HERE, LATER = 0, 1, 2, 3
#: A crowded stretch: (rank, its place in the region, its shingles).
CROWDED = 4
PAIR = ("uid", "start", "first", "last", "low", "high", "puid", "pstart")


def _crowded_functions(row, function, a, b, crowd: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each window the functions, as bits, that have a crowded key at one of its starts."""
    out = np.zeros(len(row), np.int64)
    for k in range(FUNCTIONS):
        own = np.flatnonzero(crowd & (function == k))
        if len(own):
            own = own[np.argsort(a[own])]
            at = np.searchsorted(a[own], b, "right") - 1  # intervals of one function are disjoint
            out |= np.where((at >= 0) & (b[own][np.maximum(at, 0)] >= a), 1 << k, 0)
    return out


def _candidates(n: int, enough: int = ENOUGH):
    def run(regions: pa.Table, groups: pa.Table) -> pa.Table:
        """Parts of a bucket's regions for which enough functions name the same partner, by partner:
        asks are rows of (uid, start of the region, first and last shingle in it)."""
        if not len(regions) or not len(groups):
            return CANDIDATES_PA.empty_table()
        h, offsets, key, function, row, a, b, _ = _region_windows(regions)
        uid, start, rank = (regions[c].to_numpy() for c in ("uid", "start", "rank"))
        keys, sizes, hides = (np.frombuffer(b"".join(groups[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("sizes", np.int64), ("hides", np.int64)))
        members = np.frombuffer(b"".join(groups["members"].to_pylist()), np.int64).reshape(-1, 3)
        partner, index = np.unique(mix(members[:, 0].view(np.uint64)) ^ mix((members[:, 2] + 1).view(np.uint64)), return_index=True, return_inverse=True)[1:]
        partner = members[partner]
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        spot = order[np.minimum(np.searchsorted(keys, key, sorter=order), len(keys) - 1)]
        told = keys[spot] == key
        hidden = np.where(told, hides[spot], NONE)
        also = _crowded_functions(row, function, a, b, hidden != NONE, offsets)
        b2 = regions["b2"][0].as_py()
        out = _look_up(h, uid, rank, start, offsets, row, a, b, (hidden == CROWD) & (function == 0), n, b2)
        crowd = hidden == CROWD
        who, s, e = covered_runs(row[crowd], function[crowd], a[crowd], b[crowd], enough)
        # With a passage more on both sides, as a partner's window may be wider.
        who, s, e = merge_spans(who, np.maximum(offsets[who], s - LEAST), np.minimum(offsets[who + 1], e + 2 * LEAST))
        for r, x, y in zip(who.tolist(), s.tolist(), e.tolist(), strict=True):
            out.append({"kind": CROWDED, "b2": b2, "puid": uid[r], "pstart": start[r], "asks": np.array([rank[r], x - offsets[r]]).tobytes() + h[x:y].tobytes()})
        hit = np.flatnonzero(told)
        hit = hit[np.argsort(row[hit], kind="stable")]
        spot = spot[hit]
        # A region's windows stay together, as the functions are counted over all of them.
        regions_of = X.group_edges(row[hit])
        weight = np.add.reduceat(sizes[spot], regions_of) if len(hit) else sizes[:0]
        found = []
        ends = np.append(regions_of, len(hit))
        for i, j in row_slices(np.concatenate(([0], np.cumsum(weight))), STEP) if len(hit) else ():
            w, g = hit[ends[i] : ends[j]], spot[ends[i] : ends[j]]
            p = index[ranges(begin[g], sizes[g])]
            w = np.repeat(w, sizes[g])
            earlier = partner[p, 1] < rank[row[w]]
            w, p = w[earlier], p[earlier]
            pair = row[w] * len(partner) + p
            by = np.argsort(pair, kind="stable")
            w, pair = w[by], pair[by]
            edge = X.group_edges(pair)
            if not len(edge):
                continue
            functions = np.bitwise_or.reduceat(1 << function[w] | also[w], edge)
            ok = np.repeat(np.bitwise_count(functions) >= enough, np.diff(np.append(edge, len(pair))))
            w, pair = w[ok], pair[ok]
            # All that a passage at these starts may hold, and one more passage on both sides.
            r = pair // len(partner)
            low, high = np.maximum(offsets[row[w]], a[w] - LEAST), np.minimum(offsets[row[w] + 1], b[w] + 2 * LEAST)
            who, s, e = merge_spans(pair, low, high)
            r = who // len(partner)
            base = offsets[r]
            lo = np.where(s > base, s + LEAST, s)
            hi = np.where(e < offsets[r + 1], e - 2 * LEAST, e - LEAST)
            found.append(np.stack((who % len(partner), uid[r], start[r], s - base, e - base, lo - base, np.maximum(hi, lo) - base), 1))
        found = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
        p = found[:, 0]
        now = np.zeros(len(found), bool)
        for order in (np.lexsort((p, partner[p, 1], found[:, 2], found[:, 1])), np.lexsort((p, partner[p, 1], found[:, 3] - found[:, 4], found[:, 2], found[:, 1]))):
            region = found[order][:, 1:3]
            now[order[np.concatenate(([True], (region[1:] != region[:-1]).any(1)))[: len(order)]]] = True
        out += [{"kind": COMPARE, "b2": b2, "puid": partner[k, 0], "pstart": partner[k, 2], "asks": asks.tobytes()} for k, asks in X.split_by(p[now], found[now][:, 1:5])]
        if not now.all():
            later = found[~now]
            out.append({"kind": LATER, "b2": b2, "asks": np.concatenate((later[:, 1:], partner[later[:, 0]][:, [0, 2]]), 1).tobytes()})
        return pa.Table.from_pylist(out, schema=CANDIDATES_PA)

    return run


PAIRS = "b2 long, " + ", ".join(f"{c} long" for c in PAIR)
PAIRS_PA = pa.schema([("b2", pa.int64()), *[(c, pa.int64()) for c in PAIR]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the second turn's pairs."""
    for batch in batches:
        for b2, asks in zip(batch.column("b2").to_pylist(), batch.column("asks").to_pylist(), strict=True):
            rows = np.frombuffer(asks, np.int64).reshape(-1, len(PAIR))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b2)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], schema=PAIRS_PA)


def _not_yet(pairs: pa.Table, found: pa.Table) -> pa.Table:
    """The pairs of a bucket that are still to be compared: of two components, or with a stretch that isn't known to be shared."""
    if not len(pairs):
        return CANDIDATES_PA.empty_table()
    cols = {c: pairs[c].to_numpy() for c in ("b2", *PAIR, "same")}
    owner, first, last = (np.zeros(0, np.int64) for _ in range(3))
    if len(found):
        spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in found["spans"].to_pylist()]
        owner = np.repeat(found["uid"].to_numpy(), [len(x) for x in spans])
        spans = np.concatenate(spans)
        order = np.lexsort((spans[:, 0], owner))
        owner, first, last = owner[order], spans[order, 0], spans[order, 1] - LEAST  # starts of shared passages
    # The last run of the same document that begins at or before the stretch.
    names, code = np.unique(np.concatenate((owner, cols["uid"])), return_inverse=True)
    own, asked = code[: len(owner)], code[len(owner) :]
    low, high = cols["start"] + cols["low"], cols["start"] + cols["high"]
    step = int(max(first.max(initial=0), low.max(initial=0))) + 2
    at = np.searchsorted(own * step + first, asked * step + low, "right") - 1
    known = np.zeros(len(low), bool)
    ok = at >= 0
    known[ok] = (own[at[ok]] == asked[ok]) & (last[at[ok]] >= high[ok])
    todo = ~(known & cols["same"].astype(bool))
    return _by_partner(cols["b2"][0], np.stack([cols[c][todo] for c in ("puid", "pstart", "uid", "start", "first", "last")], 1))


def _by_partner(b2: int, rows: np.ndarray) -> pa.Table:
    """The asks of a bucket, rows of (partner, its start, uid, start, first, last), for each partner."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    edge = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))) if len(rows) else []
    out = [{"kind": COMPARE, "b2": b2, "puid": part[0, 0], "pstart": part[0, 1], "asks": part[:, 2:].tobytes()} for part in np.split(rows, edge[1:])] if len(rows) else []
    return pa.Table.from_pylist(out, schema=CANDIDATES_PA)


def _stretches(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last + 1, heads, shingles, offsets) of a column of crowded stretches, some rows at a time."""
    asks = column.to_pylist()
    for i, j in row_slices(np.concatenate(([0], np.cumsum([len(x) for x in asks]))), STEP):
        heads = np.array([np.frombuffer(x, np.int64, 2) for x in asks[i:j]])
        yield i, j, heads, np.frombuffer(b"".join(x[16:] for x in asks[i:j]), np.uint64), np.concatenate(([0], np.cumsum([len(x) // 8 - 2 for x in asks[i:j]])))


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(CELLS)).astype(np.int64)


def _token(shingle: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """The ``number``-th time that a passage has a shingle: multisets in common are sets of these in common."""
    return mix(shingle + np.asarray(number).astype(np.uint64) * np.uint64(BASE))


def held_tokens(h: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, class) of all that windows of ``reach`` shingles hold, each token of a row once.  The class is the content of
    all windows with the shingle, from its first place in the row to its last."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.lexsort((h, row))
    row, name = row[place], h[place]
    edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])))) if len(h) else place
    size = np.diff(np.append(edge, len(h)))
    lane = np.repeat(np.arange(len(edge)), size) * (len(h) + reach) + place
    most = np.maximum.reduceat(np.searchsorted(lane, lane + reach) - np.arange(len(h)), edge) if len(h) else size
    row, name, first, last = row[edge], name[edge], place[edge], place[edge + size - 1]
    cls = stretch_hashes(h, np.maximum(first - reach + 1, offsets[row]), np.minimum(last + reach, offsets[row + 1]))
    return _token(np.repeat(name, most), ranges(np.ones(len(most), np.int64), most)), np.repeat(row, most), np.repeat(cls, most)


def _crowd_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Crowded stretches as regions of their own."""
    for batch in batches:
        uid, start, b2 = (batch.column(c).to_pylist() for c in ("uid", "start", "b2"))
        for i, j, heads, h, offsets in _stretches(batch.column("asks")):
            parts = [h[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            rows = zip(range(i, j), heads.tolist(), parts, strict=True)
            yield X.blobs([{"b2": b2[k], "uid": uid[k], "rank": rank, "start": start[k] + place, "shingles": x.tobytes(), "sketch": x.astype(np.uint16).tobytes()} for k, (rank, place), x in rows], REGIONS_PA)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of crowded stretches fall into each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, _, _, h, offsets in _stretches(batch.column("asks")):
            total += np.bincount(_cells(held_tokens(h, offsets)[0]), minlength=CELLS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELL_PARTS)), pa.array([x.tobytes() for x in np.split(total, CELL_PARTS)], pa.binary())], names=["part", "cells"])


def _add_cells(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["cells"].to_pylist())
    return pa.table({"part": table["part"][:1], "cells": pa.array([total.tobytes()], pa.binary())})


def _rarest_of(count: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Of each passage (a row) the rarest places, as many as near-duplicates may differ in and one more."""
    some = count.shape[1] - needed(count.shape[1], similarity) + 1
    return np.argpartition(count, some - 1, 1)[:, :some]


def rarest(count: np.ndarray, offsets: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> np.ndarray:
    """The places that are among the rarest of some passage."""
    chosen = np.zeros(len(count), bool)
    at = np.flatnonzero(window_starts(offsets, least)[0])
    for begin in range(0, len(at), WINDOW_SLICE):
        first = at[begin : begin + WINDOW_SLICE, None]
        chosen[(first + _rarest_of(count[first + np.arange(least)], similarity)).ravel()] = True
    return chosen


def numbered(rows: np.ndarray) -> np.ndarray:
    """For each place of each row how often its value stands in the row up to it."""
    order = np.argsort(rows, 1, kind="stable")
    ranked = np.take_along_axis(rows, order, 1)
    place = np.arange(rows.shape[1])
    fresh = np.ones(rows.shape, bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    out = np.empty(rows.shape, np.int64)
    np.put_along_axis(out, order, place - np.maximum.accumulate(np.where(fresh, place, 0), 1) + 1, 1)
    return out


def asked_tokens(h: np.ndarray, offsets: np.ndarray, counts: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(token, first place) of the rarest tokens of each passage.  Whatever is a near-duplicate of the passage holds one of them;
    those that no other stretch holds are left out."""
    plain = _token(h, 1)
    often = counts[_cells(plain)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.lexsort((h, row))
    again = np.full(len(h) + 1, len(h))  # where the shingle stands next in its row
    same = (row[place][1:] == row[place][:-1]) & (h[place][1:] == h[place][:-1])
    again[place[:-1][same]] = place[1:][same]
    again = np.minimum.accumulate(again[::-1])[::-1]
    at = np.flatnonzero(window_starts(offsets, least)[0])
    tokens, starts = [np.zeros(0, np.uint64)], [at[:0]]
    for begin in range(0, len(at), PASSAGE_STEP):
        first = at[begin : begin + PASSAGE_STEP]
        places = first[:, None] + np.arange(least)
        token, count = plain[places], often[places]
        several = np.flatnonzero(again[first] < first + least)
        shingle = h[places[several]]
        token[several] = _token(shingle, numbered(shingle))
        count[several] = counts[_cells(token[several])]
        chosen = _rarest_of(count, similarity)
        ask = np.take_along_axis(count, chosen, 1) > 1
        tokens.append(np.take_along_axis(token, chosen, 1)[ask])
        starts.append(np.repeat(first, ask.sum(1)))
    return np.concatenate(tokens), np.concatenate(starts)


HOLDS, PROBES = 0, 1


def _inside(row: np.ndarray, first: np.ndarray, last: np.ndarray, spans: list) -> np.ndarray:
    """Whether each stretch of a row lies in one of the row's spans (disjoint; rows of int64 pairs, or None)."""
    size = np.array([len(x or b"") // 16 for x in spans], np.int64)
    s, e = np.frombuffer(b"".join(x or b"" for x in spans), np.int64).reshape(-1, 2).T
    owner = np.repeat(np.arange(len(spans)), size)
    order = np.lexsort((s, owner))
    owner, s, e = owner[order], s[order], e[order]
    step = int(max(s.max(initial=0), first.max(initial=0))) + 1
    at = np.searchsorted(owner * step + s, row * step + first, "right") - 1
    out = at >= 0
    out[out] = (owner[at[out]] == row[out]) & (e[at[out]] >= last[out])
    return out


def _crowd_keys(n: int, counts: np.ndarray):
    """Every token of a crowded stretch with its surroundings (kind HOLDS), and the rarest of its passages, which ask.  A
    token asks once for all passages of a stretch that touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, start, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "start", "root"))
            spans = batch.column("spans").to_pylist()
            for i, j, heads, h, offsets in _stretches(batch.column("asks")):
                ids = np.stack((uid[i:j], heads[:, 0], start[i:j] + heads[:, 1], root[i:j]), 1)
                token, row, cls = held_tokens(h, offsets)
                several = np.flatnonzero(counts[_cells(token)] > 1)  # what one stretch holds has no partner
                order = several[np.lexsort((ids[row[several], 1], cls[several], token[several]))]
                token, row, cls = token[order], row[order], cls[order]
                fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))[: len(order)]
                token, row, cls = token[fresh], row[fresh], cls[fresh]
                out = [{"bucket": b, "kind": HOLDS, "keys": k.tobytes(), "classes": c.tobytes(), "ids": x.tobytes()} for b, k, c, x in X.split_by((mix(token) % np.uint64(n)).astype(np.int64), token, cls, ids[row])]
                token, first = asked_tokens(h, offsets, counts)
                row = np.searchsorted(offsets, first, "right") - 1
                first = first - offsets[row]
                covered = _inside(row, first + ids[row, 2], first + ids[row, 2] + LEAST, spans[i:j])
                names, code = np.unique(token, return_inverse=True)
                who, first, last = merge_spans((code * (j - i) + row) * 2 + covered, first, first + LEAST)
                token, row = names[who // (2 * (j - i))], who // 2 % (j - i)
                asks = np.concatenate((ids[row], np.stack((first, last, who % 2), 1)), 1)
                out += [{"bucket": b, "kind": PROBES, "keys": k.tobytes(), "ids": x.tobytes()} for b, k, x in X.split_by((mix(token) % np.uint64(n)).astype(np.int64), token, asks)]
                yield X.blobs(out, HELD_PA)

    return run


def _numbers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two numbers, and which of them each row is."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    fresh = np.concatenate(([True], (rows[order][1:] != rows[order][:-1]).any(1)))[: len(rows)]
    index = np.zeros(len(rows), np.int64)
    index[order] = np.cumsum(fresh) - 1
    return rows[order[fresh]], index


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows of (partner, its start, uid, start, first, last) with the stretches of a pair merged."""
    if not len(rows):
        return rows
    (theirs, y), (own, x) = _numbers(rows[:, :2]), _numbers(rows[:, 2:4])
    who, first, last = merge_spans(y * len(own) + x, rows[:, 4], rows[:, 5])
    return np.concatenate((theirs[who // len(own)], own[who % len(own)], first[:, None], last[:, None]), 1)


def _crowd_pairs(n: int):
    """The pairs of a bucket's tokens that are still to be compared."""

    def run(table: pa.Table) -> pa.Table:
        holds, probes = (table.filter(pc.equal(table["kind"], k)) for k in (HOLDS, PROBES))
        asked = np.frombuffer(b"".join(probes["keys"].to_pylist()), np.uint64)
        asks = np.frombuffer(b"".join(probes["ids"].to_pylist()), np.int64).reshape(-1, 7)
        key, cls = (np.frombuffer(b"".join(holds[c].to_pylist()), np.uint64) for c in ("keys", "classes"))
        ids = np.frombuffer(b"".join(holds["ids"].to_pylist()), np.int64).reshape(-1, 4)
        keys, own = np.unique(asked, return_inverse=True)
        wanted = np.flatnonzero(np.isin(key, keys))
        order = wanted[np.lexsort((ids[wanted, 2], ids[wanted, 0], ids[wanted, 1], cls[wanted], key[wanted]))]
        key, cls, ids = key[order], cls[order], ids[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))[: len(key)]
        key, ids = key[fresh], ids[fresh]
        # By key, then component: the holders of other components stand before and after an ask's own.
        roots = np.unique(np.concatenate((ids[:, 3], asks[:, 3])))
        group = np.searchsorted(keys, key)
        lane, mine = group * len(roots) + np.searchsorted(roots, ids[:, 3]), own * len(roots) + np.searchsorted(roots, asks[:, 3])
        order = np.lexsort((ids[:, 1], lane))
        group, lane, ids = group[order], lane[order], ids[order]
        begin, stop = np.searchsorted(group, own, "left"), np.searchsorted(group, own, "right")
        known = asks[:, 6] > 0
        left = np.where(known, np.searchsorted(lane, mine, "left"), stop)
        right = np.where(known, np.searchsorted(lane, mine, "right"), stop)
        who = np.tile(np.arange(len(asks)), 3)
        # Of its own component the first one, which may be the smallest document that the ask shares a passage with.
        at, size = np.concatenate((begin, left, right)), np.concatenate((left - begin, np.minimum(right - left, 1), stop - right))
        (theirs, y), (ours, x) = _numbers(ids[:, [0, 2]]), _numbers(asks[:, [0, 2]])
        found = [np.zeros((0, 3), np.int64)]
        for i, j in row_slices(np.concatenate(([0], np.cumsum(size))), PAIR_STEP):
            ask, hold = np.repeat(who[i:j], size[i:j]), ranges(at[i:j], size[i:j])
            earlier = ids[hold, 1] < asks[ask, 1]
            ask, hold = ask[earlier], hold[earlier]
            found.append(np.stack(merge_spans(y[hold] * len(ours) + x[ask], asks[ask, 4], asks[ask, 5]), 1))
            if sum(map(len, found)) > PAIR_STEP and len(found) > 16:
                found = [np.stack(merge_spans(*np.concatenate(found).T), 1)]
        pair, first, last = merge_spans(*np.concatenate(found).T)
        rows = np.concatenate((theirs[pair // len(ours)], ours[pair % len(ours)], first[:, None], last[:, None]), 1) if len(pair) else np.zeros((0, 6), np.int64)
        out = [{"kind": LATER, "b2": b, "asks": part.tobytes()} for b, part in X.split_by(X.row_buckets(np.ascontiguousarray(rows[:, 2]), n), rows)]
        return pa.Table.from_pylist(out, schema=CANDIDATES_PA)

    return run


def _crowd_asks(table: pa.Table) -> pa.Table:
    """A bucket's pairs from all shingles, each once."""
    rows = np.frombuffer(b"".join(table["asks"].to_pylist()), np.int64).reshape(-1, 6)
    return _by_partner(table["b2"][0].as_py(), _merged(rows))


def needed(least: int = LEAST, similarity: float = SIMILARITY) -> int:
    """How many shingles two stretches of ``least`` must share: with k the overlap is k / (2 * least - k) at most."""
    return int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))


def possible_parts(pieces: list[np.ndarray], theirs: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place of each piece that a passage shared with ``theirs`` may hold; 0, 0 if there is none.

    Both are 16-bit sketches.  Equal shingles have equal sketches, so that none is lost; of unequal ones few
    share one, and these only leave more to compare.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(size) - size
    have = np.zeros(1 << 16, bool)
    have[theirs] = True
    total = np.concatenate(([0], np.cumsum(have[np.concatenate(pieces)])))
    counts = np.maximum(size - least + 1, 0)
    at, piece = ranges(base, counts), np.repeat(np.arange(len(size)), counts)
    may = total[at + least] - total[at] >= needed(least, similarity)
    at, piece = at[may], piece[may]
    first, stop = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    edge = X.group_edges(piece)
    which = piece[edge]
    first[which] = at[edge] - base[which]
    stop[which] = at[np.append(edge[1:], len(at)) - 1] + least - base[which] if len(edge) else 0
    return first, stop


def _possible(regions: pa.Table, asked: pa.Table) -> pa.Table:
    """The asks of a bucket, without those and without the ends that the sketches rule out."""
    if not len(regions) or not len(asked):
        return CANDIDATES_PA.empty_table()
    own = {(u, at): np.frombuffer(t, np.uint16) for u, at, t in zip(*(regions[c].to_pylist() for c in ("uid", "start", "sketch")), strict=True)}
    out = []
    for b2, puid, pstart, theirs, asks in zip(*(asked[c].to_pylist() for c in ("b2", "puid", "pstart", "theirs", "asks")), strict=True):
        asks = np.frombuffer(asks, np.int64).reshape(-1, 4)
        first, stop = possible_parts([own[u, at][x:y] for u, at, x, y in asks.tolist()], np.frombuffer(theirs, np.uint16))
        keep = stop > 0
        if keep.any():
            rows = np.stack((asks[:, 0], asks[:, 1], asks[:, 2] + first, asks[:, 2] + stop), 1)[keep]
            out.append({"kind": COMPARE, "b2": b2, "puid": puid, "pstart": pstart, "asks": rows.tobytes()})
    return pa.Table.from_pylist(out, schema=CANDIDATES_PA)


def _look_up(h, uid, rank, start, offsets, row, a, b, crowd, n: int, b2: int) -> list[dict]:
    """The passages under crowded keys of one function: the first of each content goes to the
    content's bucket, the others are found here."""
    size = (b - a + 1)[crowd]
    at, r = ranges(a[crowd], size), np.repeat(row[crowd], size)
    if not len(at):
        return []
    content = stretch_hashes(h, at, at + LEAST)
    order = np.lexsort((rank[r], content))
    content, at, r = content[order], at[order], r[order]
    edge = X.group_edges(content)
    lead = np.repeat(edge, np.diff(np.append(edge, len(content))))
    place = at - offsets[r] + start[r]
    later = rank[r] > rank[r[lead]]
    out = []
    if later.any():
        rows = np.stack((uid[r], place, uid[r[lead]], rank[r[lead]]), 1)[later]
        out.append({"kind": FOUND_HERE, "b2": b2, "asks": rows.tobytes()})
    rows = np.stack((content.view(np.int64), uid[r], rank[r], place), 1)[~later]
    for home, part in X.split_by((mix(content[~later]) % np.uint64(n)).astype(np.int64), rows):
        out.append({"kind": LOOK_UP, "b2": home, "asks": part.tobytes()})
    return out


def _same_content(n: int):
    """The first document of each content, told to the later ones."""

    def run(table: pa.Table) -> pa.Table:
        content, uid, rank, place = np.frombuffer(b"".join(table["asks"].to_pylist()), np.int64).reshape(-1, 4).T
        order = np.lexsort((rank, content))
        content, uid, rank, place = (x[order] for x in (content, uid, rank, place))
        edge = X.group_edges(content)
        lead = np.repeat(edge, np.diff(np.append(edge, len(content))))
        rows = np.stack((uid, place, uid[lead], rank[lead]), 1)[rank > rank[lead]]
        home = X.row_buckets(np.ascontiguousarray(rows[:, 0]), n)
        out = [{"kind": FOUND_HERE, "b2": b, "asks": part.tobytes()} for b, part in X.split_by(home, rows)]
        return pa.Table.from_pylist(out, schema=CANDIDATES_PA)

    return run


def _overlap(part: np.ndarray, names: np.ndarray, at: np.ndarray, enough: int, similarity: float) -> bool:
    """Whether a window over the places ``at`` (sorted, of the shingles ``names``) shares enough of ``part`` as a multiset."""
    least = len(part)
    have = Counter(part.tolist())
    names, at = names.tolist(), at.tolist()
    # The longest window at each start bounds what any window from there shares.
    reach = int(least / similarity + 1e-9)
    inside, k, stop = Counter(), 0, 0
    for begin, place in enumerate(at):
        while stop < len(at) and at[stop] - place < reach:
            inside[names[stop]] += 1
            k += inside[names[stop]] <= have[names[stop]]
            stop += 1
        if k >= enough:
            own, shared = Counter(), 0
            for j in range(begin, stop):
                own[names[j]] += 1
                shared += own[names[j]] <= have[names[j]]
                if shared >= enough and shared >= similarity * (least + at[j] - place + 1 - shared) - 1e-9:
                    return True
        k -= inside[names[begin]] <= have[names[begin]]
        inside[names[begin]] -= 1
    return False


def ordered(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a partner's shingles in their order, and the shingles in it."""
    order = np.argsort(y, kind="stable")
    return order, y[order]


def aligned(x: np.ndarray, y: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY, known: tuple | None = None) -> list[tuple[int, int]]:
    """The parts of x that are near-duplicates of parts of y.

    A stretch of ``least`` shingles of x is good if its overlap with some window of y, as multisets, reaches
    ``similarity``, with as many in common as two stretches of that length need.  The parts are
    the union of the good stretches; of those that would cover the next place the last is tried first.
    """
    if len(x) < least:
        return []
    order, ranked = known or ordered(y)
    lo, hi = np.searchsorted(ranked, x, "left"), np.searchsorted(ranked, x, "right")
    enough = needed(least, similarity)
    met = np.flatnonzero(hi > lo)
    if len(met) < enough:
        return []
    if met[-1] - met[0] == len(met) - 1 and (hi - lo)[met].max() == 1 and ((spot := order[lo[met]]) - met == spot[0] - met[0]).all():
        # One stretch that stands in y as it is, and nothing else in common: stretches with ``enough`` of it are good.
        begin, end = max(0, int(met[0]) - least + enough), min(len(x) - least, int(met[-1]) + 1 - enough)
        return [(begin, end + least)] if end >= begin else []
    total = np.concatenate(([0], np.cumsum(hi > lo)))
    maybe = total[least:] - total[:-least] >= enough
    reach = int(least / similarity + 1e-9)
    again = np.zeros(len(y), bool)  # the same shingle stands less than a window before
    again[order[1:]] = (ranked[1:] == ranked[:-1]) & (order[1:] - order[:-1] < reach)
    shared = np.arange(enough, least + 1)
    widest = np.floor(shared / similarity - least + shared + 1e-9).astype(np.int64)

    # Stretches with enough at one distance from y, by shingles with one place in it: these have distinct places there,
    # in a window of ``least``.
    shift = np.where(hi - lo == 1, order[np.minimum(lo, len(y) - 1)] - np.arange(len(x)), -len(x) - 1)
    values, times = np.unique(shift[shift >= -len(x)], return_counts=True)
    sure = np.zeros(len(maybe), bool)
    for value in values[times >= enough]:
        same = np.concatenate(([0], np.cumsum(shift == value)))
        sure |= same[least:] - same[:-least] >= enough
    sure = sure.tolist()

    def good(i: int) -> bool:
        if sure[i]:
            return True
        part = x[i : i + least]
        names, first = np.unique(part, return_index=True)
        first += i
        spots = np.sort(order[ranges(lo[first], hi[first] - lo[first])])
        if len(names) < least or again[spots].any():
            return _overlap(part, y[spots], spots, enough, similarity)
        return any(len(spots) >= k and (spots[k - 1 :] - spots[: len(spots) - k + 1] < w).any() for k, w in zip(shared.tolist(), widest.tolist(), strict=True))

    begin, done, i, n = [], -1, 0, len(maybe)
    can = np.flatnonzero(maybe).tolist()
    while i < n:
        stop = bisect_right(can, min(i, n - 1))
        found = next((t for t in reversed(can[bisect_right(can, done) : stop]) if good(t)), None)
        if found is None:
            # Nothing covers this place: go on to the next start that may.
            if stop == len(can):
                break
            i = can[stop]
            done = i - 1
            continue
        begin.append(found)
        done = found
        i = min(found + least, n - 1) if found < n - 1 else n
    if not begin:
        return []
    begin = np.array(begin)
    _, s, e = merge_spans(np.zeros(len(begin), np.int64), begin, begin + least)
    return list(zip(s.tolist(), e.tolist(), strict=True))


FOUND = "uid long, other long, n_passages long, n_dup_words long, least long, spans binary"
FOUND_PA = pa.schema([*[(c, pa.int64()) for c in ("uid", "other", "n_passages", "n_dup_words", "least")], ("spans", pa.binary())])


def _verify(regions: pa.Table, asked: pa.Table) -> pa.Table:
    """What a bucket's documents share with earlier ones: for each its passages and words, the smallest
    rank it is linked to and the stretches of shingles; and the links (other).

    Partners come in order of rank: an ask for what is shared by now adds nothing if the document is linked to the partner's component."""
    if not len(asked):
        return FOUND_PA.empty_table()
    asked = asked.sort_by("prank")
    shared, linked = {}, set()
    for u, asks in zip(*(asked.filter(pc.equal(asked["kind"], LATER))[c].to_pylist() for c in ("puid", "asks")), strict=True):
        shared[u] = np.frombuffer(asks, np.int64).reshape(-1, 2).tolist()
    own = {(u, at): np.frombuffer(t, np.uint64) for u, at, t in zip(*(regions[c].to_pylist() for c in ("uid", "start", "shingles")), strict=True)}
    spans, known = [np.zeros((0, 5), np.int64)], {}
    for kind, pu, prank, root, theirs, asks in zip(*(asked[c].to_pylist() for c in ("kind", "puid", "prank", "proot", "theirs", "asks")), strict=True):
        if kind == FOUND_HERE:
            u, at, puid, rank = np.frombuffer(asks, np.int64).reshape(-1, 4).T
            spans.append(np.stack((u, at, at + LEAST, puid, rank), 1))
            continue
        if kind == LATER:  # what the first turn found; it is linked already
            rows = np.frombuffer(asks, np.int64).reshape(-1, 2)
            spans.append(np.stack((np.full(len(rows), pu), rows[:, 0], rows[:, 1], np.full(len(rows), pu), np.full(len(rows), prank)), 1))
            continue
        y = np.frombuffer(theirs, np.uint64)
        places = None
        for u, at, x, stop in np.frombuffer(asks, np.int64).reshape(-1, 4).tolist():
            if root is not None and (u, root) in linked and any(s <= at + x and at + stop <= e for s, e in shared.get(u, ())):
                continue
            places = places or ordered(y)
            piece = own[u, at][x:stop]
            # Equal pieces and regions are compared once.
            name = (piece.tobytes(), theirs)
            if (parts := known.get(name)) is None:
                parts = known[name] = aligned(piece, y, known=places)
            if parts:
                spans.append(np.array([(u, at + x + s, at + x + e, pu, prank) for s, e in parts], np.int64))
                linked.add((u, root))
                shared.setdefault(u, []).extend((at + x + s, at + x + e) for s, e in parts)
    uid, start, stop, puid, prank = np.concatenate(spans).T
    if not len(uid):
        return FOUND_PA.empty_table()
    who, s, e = merge_spans(uid, start, stop)
    names, first = np.unique(who, return_index=True)
    least = np.full(len(names), X.LAST)
    np.minimum.at(least, np.searchsorted(names, uid), prank)
    blobs = [part.tobytes() for part in np.split(np.stack((s, e), 1), first[1:])]
    wide, ws, we = merge_spans(uid, start, stop + SHINGLE - 1)
    index = np.searchsorted(names, wide)
    links = np.unique(np.stack((uid, puid), 1)[uid != puid], axis=0)
    own_rows = pa.table([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(np.bincount(index)), pa.array(np.bincount(index, we - ws).astype(np.int64)), pa.array(least), pa.array(blobs, pa.binary())], schema=FOUND_PA)
    none = pa.nulls(len(links), pa.int64())
    return pa.concat_tables([own_rows, pa.table([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1])), none, none, none, pa.nulls(len(links), pa.binary())], schema=FOUND_PA)])


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, leaders: int = LEADERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_passages (maximal runs of its words that are
    near-duplicates of earlier documents'), n_dup_words, first_id (the smallest document it was found to share one with),
    component_id (the smallest id reachable over passages shared)."""
    n = X.bucket_count(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col), F.lit(int(X.LAST))).cast("long").alias("rank"), text.alias("text"))
    ids = rows.select("doc_id", "rank", F.xxhash64("rank", "text").alias("uid"), F.sha2("text", 256).alias("sha"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    ids = materialize(ids, "ids")
    first = ids.groupBy("sha").agg(F.min_by(F.struct("rank", "uid"), "rank").alias("f"), F.count("*").alias("n")).where("n > 1")
    # Written before it is joined: Spark then splits a text that much of all rows copy.
    first = materialize(first.select("sha", F.col("f.uid").alias("first_uid"), F.col("f.rank").alias("first_rank")), "first")
    whole = (F.col("n_words") > 0) & F.col("first_uid").isNotNull()
    leader = [F.when(whole, F.col(f"first_{c}")).otherwise(F.col(c)).alias(f"first_{c}") for c in ("uid", "rank")]
    who = materialize(ids.join(first, "sha", "left").select("doc_id", "rank", "uid", "n_words", *leader), "who")
    copies = who.where("uid <> first_uid").select("uid").distinct()
    again = materialize(who.groupBy("uid").count().where("count > 1").select("uid"), "again")
    rows = rows.where(F.octet_length("text") >= 2 * PASSAGE_WORDS - 1).withColumn("uid", F.xxhash64("rank", "text"))
    alone = X.once(rows.join(copies, "uid", "left_anti").select("uid", "rank", "text"), again).withColumn("b2", X.row_bucket_column("uid", n))
    shared = materialize(alone.select("uid", "text").mapInArrow(_ask(n), MAPPED).groupBy("bucket").applyInArrow(_answer_shared(n), REPLY), "shared", large=True)
    # In buckets of b2, so that the three steps that group them don't shuffle them.
    regions = bucketed(alone.select("b2", "uid", "rank", "text").groupBy("b2").cogroup(shared.groupBy("b2")).applyInArrow(_regions, REGIONS), "regions", "b2", n)
    release(docs.sparkSession)
    discard(shared)
    whole_regions = regions.select("b2", "uid", "rank", "start", "shingles")
    groups = whole_regions.mapInArrow(_held_keys(n, classes), HELD).groupBy("bucket").applyInArrow(_group_members(classes, leaders), GROUPS)
    candidates = materialize(whole_regions.groupBy("b2").cogroup(groups.groupBy("b2")).applyInArrow(_candidates(n), CANDIDATES), "candidates", large=True)
    columns = ["kind", "b2", "puid", "prank", "proot", "theirs", "asks"]

    def compared(regions: DataFrame, asks: DataFrame, more: DataFrame, name: str) -> DataFrame:
        """The asks with their partners' shingles, and found places, against the regions."""
        theirs = regions.select(F.col("uid").alias("puid"), F.col("start").alias("pstart"), F.col("rank").alias("prank"), F.col("shingles").alias("theirs"))
        asked = asks.join(theirs, ["puid", "pstart"]).select(*columns).unionByName(more.select(*columns))
        return materialize(regions.select("b2", "uid", "start", "shingles").groupBy("b2").cogroup(asked.groupBy("b2")).applyInArrow(_verify, FOUND), name, large=True)

    null = lambda kind: F.lit(None).cast(kind)
    same = candidates.where(f"kind = {LOOK_UP}").groupBy("b2").applyInArrow(_same_content(n), CANDIDATES)
    same = same.unionByName(candidates.where(f"kind = {FOUND_HERE}")).withColumns({"prank": null("long"), "proot": null("long"), "theirs": null("binary")})
    turn = compared(regions, candidates.where(f"kind = {COMPARE}").withColumn("proot", null("long")), same, "first_turn")
    shared = turn.where("other IS NULL").withColumn("b2", X.row_bucket_column("uid", n))
    roots = materialize(connect(turn.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b"))), "roots")
    pairs = candidates.where(f"kind = {LATER}").select("b2", "asks").mapInArrow(_pairs, PAIRS)
    for c in ("uid", "puid"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c, "left")
    pairs = pairs.withColumn("same", F.coalesce("r_uid", "uid") == F.coalesce("r_puid", "puid")).select("b2", *PAIR, "same")
    todo = pairs.groupBy("b2").cogroup(shared.select("b2", "uid", "spans").groupBy("b2")).applyInArrow(_not_yet, CANDIDATES)
    todo = materialize(todo, "todo", large=True)

    def sifted(regions: DataFrame, todo: DataFrame, shared: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """The asks that the sketches leave are compared; with what is shared already.

        Most pairs of the second turn only share less than a passage: sketches tell, a quarter of the shingles' size."""
        sketches = regions.select(F.col("uid").alias("puid"), F.col("start").alias("pstart"), F.col("sketch").alias("theirs"))
        asked = todo.join(sketches, ["puid", "pstart"]).select("b2", "puid", "pstart", "theirs", "asks")
        possible = regions.select("b2", "uid", "start", "sketch").groupBy("b2").cogroup(asked.groupBy("b2")).applyInArrow(_possible, CANDIDATES)
        possible = possible.join(roots.select(F.col("node").alias("puid"), F.col("root").alias("proot")), "puid", "left").withColumn("proot", F.coalesce("proot", "puid"))
        possible = materialize(possible, "possible", large=True)
        discard(todo)
        before = shared.select(F.lit(LATER).alias("kind"), "b2", F.col("uid").alias("puid"), F.col("least").alias("prank"), null("long").alias("proot"), null("binary").alias("theirs"), F.col("spans").alias("asks"))
        found = compared(regions, possible, before, name)
        discard(possible)
        return found

    def linked(found: DataFrame, roots: DataFrame) -> DataFrame:
        """Components: the links of the turns before are the stars of theirs by now."""
        links = found.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b"))
        return connect(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    found = sifted(regions, todo, shared, roots, "second_turn")
    roots = linked(found, roots)
    # What only crowded keys hold, if there is any.
    crowd = candidates.where(f"kind = {CROWDED}").select("b2", F.col("puid").alias("uid"), F.col("pstart").alias("start"), "asks")
    if not crowd.isEmpty():
        stretches = materialize(crowd.mapInArrow(_crowd_regions, REGIONS), "stretches")
        counts = crowd.select("asks").mapInArrow(_count_cells, "part long, cells binary").groupBy("part").applyInArrow(_add_cells, "part long, cells binary")
        # 2 MB, whatever the input.
        counts = np.concatenate([np.frombuffer(r["cells"], np.int64) for r in sorted(counts.collect(), key=lambda r: r["part"])])
        crowd = crowd.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        crowd = crowd.join(found.where("other IS NULL").select("uid", "spans"), "uid", "left")
        pairs = crowd.mapInArrow(_crowd_keys(n, counts), HELD).groupBy("bucket").applyInArrow(_crowd_pairs(n), CANDIDATES)
        todo = materialize(pairs.groupBy("b2").applyInArrow(_crowd_asks, CANDIDATES), "todo", large=True)
        shared = found.where("other IS NULL").withColumn("b2", X.row_bucket_column("uid", n))
        found = sifted(stretches, todo, shared, roots, "third_turn")
        discard(stretches)
        roots = linked(found, roots)
    discard(candidates)
    discard(regions)

    own = found.where("other IS NULL").select("uid", "n_passages", "n_dup_words", F.col("least").alias("first_partner"))
    ranks = who.select("uid", "rank").distinct()
    named = smallest_of_component(roots, ranks, "uid", "rank").withColumnRenamed("node", "uid")
    facts = named.withColumnRenamed("least", "smallest").join(own, "uid", "left")
    facts = materialize(facts.withColumnRenamed("uid", "first_uid"), "facts")
    out = who.join(facts, "first_uid", "left")
    copy = F.col("uid") != F.col("first_uid")
    known = lambda c: F.when(F.col(c) < int(X.LAST), F.col(c))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, (F.col("n_words") > 0).cast("long")).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_dup_words", F.lit(0))).cast("long").alias("n_dup_words"),
        F.when(copy, known("first_rank")).otherwise(known("first_partner")).alias("first_id"),
        F.coalesce(known("smallest"), known("first_rank")).alias("component_id"),
    )
