"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits are linked; a component is
everything reachable over links.  For m bit partitions and thresholds that sum to
distance - m + 1, two linked fingerprints are within the threshold in one
partition at least.

1. Equal fingerprints are one node (an aggregate with map-side sums).
2. Correlated bits go into the same partition, so that crowded values meet in
   few partitions and a query can pass those over.
3. For each fingerprint a dynamic program gives each partition a threshold of its own
   (-1: not probed), least in probes plus candidates.  Candidates are estimated from
   exact counts of half partitions, tables of at most 2**16 entries.
4. Probes and index entries meet in blocks by partition value, and each
   candidate is verified on all 64 bits.

A fingerprint whose best plan costs more than 65 (a crowd of near copies) sends
itself and its 64 one-bit neighbours instead: two fingerprints are within two bits
exactly if they share one of these, and those that share one are chained to the
smallest.  No group is ever compared pair by pair, and none is left out.  This holds for distance 2,
the default; at other distances crowds are probed and verified like all others, which is exact as well but
compares a crowd pair by pair.

A text without words has the fingerprint zero and is linked like any other; null
texts are empty; rows of equal id share their component; a component of null ids
only has a null id.  Columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import exchange as X
from tilewright.llm.components import connect, forest, smallest_of_component
from tilewright.llm.storage import materialize, text_batches
from tilewright.llm.vectors import LOWER, mix, ranges

DISTANCE = 2
SHINGLE = 3
SEED = 42
PLAN_LIMIT = 65.0
GROUP_LIMIT = 512
LOWER_BYTES = LOWER.tobytes()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n < 1:
        values = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) + 1 for w in words], out=at[1:])
        values = [digest(line[s:e], SEED) for s, e in zip(at[:n].tolist(), (at[size:] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 18):
        part = np.array(values[i : i + (1 << 18)], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of the 64 bits, of equal width, each grown from the most correlated
    pair left by the bit closest to it.  together[i, j]: fingerprints with both bits."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, -1)
    left, out = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        if k == parts - 1:
            out.append(left)
            break
        sub = corr[np.ix_(left, left)]
        a, b = divmod(int(sub.argmax()), len(left))
        group = [left[a], left[b]]
        while len(group) < width:
            rest = [x for x in left if x not in group]
            group.append(rest[int(corr[np.ix_(group, rest)].sum(0).argmax())])
        out.append(sorted(group))
        left = [x for x in left if x not in group]
    return out


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of some bits of each fingerprint."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Partitions, and how many fingerprints lie near a value of a half partition."""

    def __init__(self, parts: list[list[int]], counts: list[np.ndarray], n: int, distance: int) -> None:
        self.parts, self.n, self.distance = parts, n, distance
        self.halves = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        self.near = []  # for each half: share at distance exactly 0, 1, ..
        for half, table in zip(self.halves, counts, strict=True):
            values, shares = np.arange(len(table)), []
            for d in range(distance + 1):
                total = np.zeros(len(table))
                for flips in itertools.combinations(range(len(half)), d):
                    total += table[values ^ sum(1 << f for f in flips)]
                shares.append((total / max(n, 1)).astype(np.float32))
            self.near.append(np.array(shares))

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """(partition, threshold, fingerprint): probes and estimated candidates."""
        out = np.zeros((len(self.parts), self.distance + 1, len(fp)))
        for i, part in enumerate(self.parts):
            a = self.near[2 * i][:, gather(fp, self.halves[2 * i]).astype(np.int64)]
            b = self.near[2 * i + 1][:, gather(fp, self.halves[2 * i + 1]).astype(np.int64)]
            probes, within = 0, np.zeros(len(fp))
            for t in range(self.distance + 1):
                probes += len(list(itertools.combinations(range(len(part)), t)))
                within = within + sum(a[x] * b[t - x] for x in range(t + 1))
                out[i, t] = probes + self.n * within
        return out

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best thresholds (fingerprint, partition) and their cost, by dynamic programming
        over partitions and the sum of thresholds so far."""
        m, costs = len(self.parts), self.costs(fp)
        goal = self.distance - m + 1
        span = range(-m, goal + m)
        best = {s: (np.zeros(len(fp)) if s == 0 else None) for s in span}
        choice = []
        for i in range(m):
            new: dict[int, np.ndarray | None] = {}
            pick: dict[int, np.ndarray] = {}
            for s in span:
                value, arg = None, None
                for t in range(-1, self.distance + 1):
                    prior = best.get(s - t)
                    if prior is None:
                        continue
                    cost = prior + (0 if t < 0 else costs[i, t])
                    if value is None:
                        value, arg = cost, np.full(len(fp), t)
                    else:
                        arg = np.where(cost < value, t, arg)
                        value = np.minimum(cost, value)
                new[s], pick[s] = value, arg
            best = new
            choice.append(pick)
        out = np.zeros((len(fp), m), np.int64)
        s = np.full(len(fp), goal)
        for i in range(m - 1, -1, -1):
            t = np.zeros(len(fp), np.int64)
            for v in np.unique(s):
                at = s == v
                t[at] = choice[i][int(v)][at]
            out[:, i] = t
            s = s - t
        return out, best[goal]


def partition_key(part: int, value: np.ndarray) -> np.ndarray:
    return mix(value + np.uint64((part + 1) << 40))


def neighbour_keys(fp: np.ndarray) -> np.ndarray:
    """(65, fingerprint): each fingerprint and its 64 one-bit neighbours."""
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    return fp[None, :] ^ flips[:, None]


MAPPED = "bucket long, kind int, fps binary, keys binary"
MAPPED_PA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("fps", pa.binary()), ("keys", pa.binary())])
INDEX, PROBE, NEIGHBOUR = 0, 1, 2


def _deal(plan: Plan, n_buckets: int):
    def entries(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        chosen, cost = plan.thresholds(fp)
        crowd = (cost > PLAN_LIMIT) & (plan.distance == DISTANCE)
        single = plan.costs(fp)[:, 0, :]
        for i, part in enumerate(plan.parts):
            value = gather(fp, part)
            asked = (single[i] <= PLAN_LIMIT) | (plan.distance != DISTANCE)  # no plan within the limit probes any other value
            yield INDEX, fp[asked], partition_key(i, value[asked])
            for t in range(plan.distance + 1):
                at = np.flatnonzero((chosen[:, i] >= t) & ~crowd)
                for flips in itertools.combinations(range(len(part)), t) if len(at) else ():
                    flip = np.uint64(sum(1 << f for f in flips))
                    yield PROBE, fp[at], partition_key(i, value[at] ^ flip)
        if crowd.any():
            keys = neighbour_keys(fp[crowd])
            yield NEIGHBOUR, np.tile(fp[crowd], len(keys)), mix(keys.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 20_000):
                by: dict[int, list] = {}
                for kind, f, k in entries(fp[at : at + 20_000]):
                    by.setdefault(kind, []).append((f, k))
                out = []
                for kind, parts in by.items():
                    f, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                    for b, fs, ks in X.split_by((k % np.uint64(n_buckets)).astype(np.int64), f, k):
                        out.append({"bucket": b, "kind": kind, "fps": fs.tobytes(), "keys": ks.tobytes()})
                yield X.blobs(out, MAPPED_PA)

    return run


def star_links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest under the same key."""
    order = np.lexsort((fp, keys))
    keys, fp = keys[order], fp[order]
    edge = X.group_edges(keys)
    least = np.repeat(fp[edge], np.diff(np.append(edge, len(keys))))
    other = fp != least
    return fp[other], least[other]


def verified(ik: np.ndarray, ifp: np.ndarray, pk: np.ndarray, pfp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between probes and index entries of equal key, checked on all bits."""
    order = np.argsort(ik, kind="stable")
    ik, ifp = ik[order], ifp[order]
    lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
    size = hi - lo
    large = (size > GROUP_LIMIT) & (distance == DISTANCE)
    if large.any():  # an underestimated crowd: by shared neighbours, not by pairs
        for k in np.unique(pk[large]):
            members = np.unique(np.concatenate((ifp[np.searchsorted(ik, k, "left") : np.searchsorted(ik, k, "right")], pfp[pk == k])))
            yield star_links(neighbour_keys(members).ravel(), np.tile(members, 65))
    at = np.flatnonzero(~large & (size > 0))
    for part in np.array_split(at, max(1, int(size[at].sum()) // 2_000_000 + 1)):
        other = ifp[ranges(lo[part], size[part])]
        own = np.repeat(pfp[part], size[part])
        ok = (np.bitwise_count(own ^ other) <= distance) & (own != other)
        yield own[ok], other[ok]


LINKS = "a long, b long"
LINKS_PA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(distance: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = {}
        for kind in (INDEX, PROBE, NEIGHBOUR):
            own = table.filter(pc.equal(table["kind"], kind))
            kinds[kind] = tuple(np.frombuffer(b"".join(own[c].to_pylist()), np.uint64) for c in ("keys", "fps"))
        found = list(verified(*kinds[INDEX], *kinds[PROBE], distance))
        found.append(star_links(*kinds[NEIGHBOUR]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        a, b = forest(a, b)
        return pa.table([a, b], schema=LINKS_PA)

    return run


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = (fp[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])


def _half_counts(halves: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << len(h), np.int64) for h in halves]
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, half in zip(totals, halves, strict=True):
                t += np.bincount(gather(fp, half).astype(np.int64), minlength=len(t))
        for k, t in enumerate(totals):
            v = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(t[v])], names=["half", "value", "n"])

    return run


def make_plan(nodes: DataFrame, distance: int = DISTANCE) -> Plan:
    """The partitions and tables for a table of distinct fingerprints ``fp``."""
    n = nodes.count()
    m = max(2, min(4, int(64 // max(16.0, float(np.log2(max(n, 2)))))))
    together = np.zeros((64, 64))
    for r in nodes.mapInArrow(_bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    parts = group_bits(together, n, m)
    halves = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
    counts = [np.zeros(1 << len(h)) for h in halves]
    # At most 2m * 2**16 rows, whatever the input.
    for r in nodes.mapInArrow(_half_counts(halves), "half long, value long, n long").groupBy("half", "value").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.half][r.value] = r.n
    return Plan(parts, counts, n, distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        prints = materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    plan = make_plan(nodes.select("fp"), distance)
    n_buckets = max(48, plan.n // 50_000 + 1)
    links = nodes.select("fp").mapInArrow(_deal(plan, n_buckets), MAPPED).groupBy("bucket").applyInArrow(_link(distance), LINKS)
    roots = connect(links)  # node, root of every linked node
    least = smallest_of_component(roots, nodes, "fp", "first")
    component = nodes.join(least, nodes.fp == least.node, "left").select(F.col("fp").alias("node"), F.coalesce("least", "first").alias("component_id"))
    component = materialize(component, "component")
    out = prints.join(component, prints.fp == component.node, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (rows of equal id
    stay together; rows without an id are kept)."""
    found = near_duplicates(docs, id_col, text_col, distance)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
