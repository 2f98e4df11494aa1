"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.storage import discard, materialize

ROUNDS = 60
#: Links that a task contracts at once.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, one for each node but the smallest of each."""
    if not len(a):
        return a, b
    names, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with the same components as the task's, without those that others imply."""

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK:
            yield part(held)
            held, rows = [], 0
    if rows:
        yield part(held)


def _mark(links: DataFrame) -> tuple:
    """A row that differs for different sets of links (but for collisions of 2 x 64 bits)."""
    hashes = [F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "b", "a")]
    return tuple(links.agg(F.count("*"), *[F.bit_xor(h) for h in hashes]).first())


def connect(links: DataFrame) -> DataFrame:
    """node, root for each node of the links a-b; root is the smallest node reachable.

    Each task first contracts the links it reads to stars, which leaves fewer links and rounds.
    Each round is two shuffles of at most one link for each node and neighbour; it ends
    when the links are stars.  Every round is written to the shared folder.
    """
    links = links.where("a != b").select("a", "b").mapInArrow(_contract, "a long, b long")
    now = materialize(links.distinct(), "links")
    mark = _mark(now)
    for _ in range(ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Minima are written before they are joined: Spark then splits the links of a hub.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        after = materialize(small, "links")
        for done in (least, large, low):
            discard(done)
        # A set of links is told from others by its size and two 64-bit sums over hashes of its links.
        mark, last = _mark(after), mark
        discard(now)
        now = after
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def smallest_of_component(roots: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """node, least: for each linked node the smallest value in its component, from the roots that
    connect() gives and a table (node, value).  The table of roots is written before it is joined, so
    that Spark can split a component that holds much of all rows."""
    linked = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(linked.join(values.select(F.col(node).alias("node"), F.col(value).alias("value")), "node"), "members")
    least = materialize(members.groupBy("root").agg(F.min("value").alias("least")), "least")
    return members.join(least, "root").select("node", "least")
