"""Where intermediate tables live: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    Only a local session (one machine, one process) that names none gets a temporary folder of its own;
    on a cluster that would be a folder the executors can't see, so there the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    return _own[context.applicationId]


#: Rows of a batch of whole texts.
TEXT_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Whole texts go to Python in batches of at most ``rows``: the JVM and the worker hold a batch each, for every task."""
    before = spark.conf.get(BATCH_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files every executor can read, so losing an executor
    never recomputes or loses an earlier step.  ``large``: the step's shuffle files are worth
    waiting for their removal.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    if large:
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``n`` buckets of a column, so that it can be grouped by it without a shuffle."""
    spark = df.sparkSession
    table = f"tilewright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(min(n, 100_000), by).saveAsTable(table)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if not path.endswith(x[1].split("://")[-1])]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are over.

    Spark removes them once the driver's JVM has collected the plans that own them, and those
    go when Python has let go of them; a second round takes what the first one freed.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM is already gone at interpreter exit
                return
