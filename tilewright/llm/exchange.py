"""Asking the whole corpus about content keys, with bounded memory per task.

A step that must know "does this key occur elsewhere?" packs its (key, row id)
entries into one binary row per batch and key bucket.  Every batch sends a key
at most once, so a key that a third of all rows hold costs a bucket one entry per
batch; what a batch can decide alone it answers itself.  Answers travel back in
binary rows per row bucket.  Bucket counts follow the input's bytes, so a bucket
keeps its size as the corpus grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes for each bucket.
BUCKET_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max


def bucket_count(df: DataFrame, column: str, bucket_bytes: int = BUCKET_BYTES, least: int = 48) -> int:
    """Buckets for the whole text of ``df``: by its bytes, ``least`` at least."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, int(total // bucket_bytes) + 1)


def split_by(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns of that bucket) for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    columns = [c[order] for c in columns]
    for b, *parts in zip(bucket[np.concatenate(([0], cuts))] if len(bucket) else [], *[np.split(c, cuts) for c in columns], strict=False):
        yield (int(b), *parts)


def group_edges(keys: np.ndarray) -> np.ndarray:
    """First index of each run in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def row_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each row id; ids are hashes."""
    return (ids.view(np.uint64) % np.uint64(n)).astype(np.int64)


def row_bucket_column(uid: str, n: int):
    """The same as row_buckets() in Spark: of the unsigned value of a long."""
    c = F.col(uid)
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(n)) * F.lit((1 << 32) % n) + F.pmod(low, F.lit(n)), F.lit(n))


def blobs(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def once(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` with one row for each uid; ``again`` holds the uids that stand in several rows.
    Only those are aggregated (with map-side combine), so that one row repeated many times
    doesn't meet in a task."""
    repeated = rows.join(again, "uid", "left_semi")
    others = [F.first(c).alias(c) for c in rows.columns if c != "uid"]
    return rows.join(again, "uid", "left_anti").unionByName(repeated.groupBy("uid").agg(*others).select(*rows.columns))
