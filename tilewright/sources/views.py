"""Raster and annotation views over business tables, as DataFrames and as SQL.

Stand-ins for images and annotation stores: embeddings become pixels, orders become drawn
elements, customers become items in a folder tree, events a version history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 8
ACROSS = 25
ACROSS3 = 13
WIDTH = TILE * ACROSS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "e")).withColumn("value", F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, value: a one-band raster of 8x8 native tiles, 25 across."""
    p = _pixels(spark, sf_dir)
    x = (F.col("vec_id") % ACROSS) * TILE + F.col("d") % TILE
    y = F.expr(f"vec_id div {ACROSS}") * TILE + F.expr(f"d div {TILE}")
    return p.select(x.alias("x"), y.alias("y"), "value")


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of pixels of mosaic(), from the table's greatest vector."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else (last // ACROSS + 1) * TILE


def mosaic3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, x, y, value: the vectors, three to a tile, as a three-band raster, 13 tiles across.
    One or two vectors at the end that make no whole tile are left out."""
    whole = table(spark, sf_dir, "embeddings").agg((F.expr("count(*) div 3") * 3).alias("whole"))
    p = _pixels(spark, sf_dir).join(F.broadcast(whole), F.col("vec_id") < F.col("whole"))
    x = (F.expr("vec_id div 3") % ACROSS3) * TILE + F.col("d") % TILE
    y = F.expr(f"(vec_id div 3) div {ACROSS3}") * TILE + F.expr(f"d div {TILE}")
    return p.select((F.col("vec_id") % 3).alias("band"), x.alias("x"), y.alias("y"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, value: the pixels of mosaic() with the label as frame."""
    p = _pixels(spark, sf_dir)
    x = (F.col("vec_id") % ACROSS) * TILE + F.col("d") % TILE
    y = F.expr(f"vec_id div {ACROSS}") * TILE + F.expr(f"d div {TILE}")
    return p.select(F.col("label").alias("frame"), x.alias("x"), y.alias("y"), "value")


def element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn elements: one for each order."""
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    kind = F.expr("CASE o_orderstatus WHEN 'O' THEN 'rectangle' WHEN 'F' THEN 'circle' ELSE 'point' END")
    return o.select(
        F.col("o_custkey").alias("annotation"),
        F.col("o_orderkey").alias("id"),
        kind.alias("type"),
        F.col("o_orderpriority").alias("grp"),
        (F.col("o_orderkey") % 1000 * 10).cast("double").alias("cx"),
        F.expr("CAST(CAST(floor(o_totalprice) AS bigint) % 10000 AS double)").alias("cy"),
        (F.col("o_orderkey") % 40 + 8).cast("double").alias("width"),
        (F.col("o_orderkey") % 40 + 8).cast("double").alias("height"),
        F.col("o_orderdate").alias("created"),
        version.cast("long").alias("version"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("annotation"), F.col("event_id").alias("version"), F.col("ts").alias("updated"), (F.col("event_type") != "error").alias("active"), F.col("event_type").alias("kind"))


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level tree: a root, regions (1000 + key) below it, nations below regions."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("folder"), F.lit(9999).alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("folder"), (F.col("n_regionkey") + 1000).alias("parent"), F.col("n_name").alias("name"))
    root = spark.range(1).select(F.lit(9999).alias("folder"), F.lit(None).cast("int").alias("parent"), F.lit("root").alias("name"))
    return root.unionByName(r).unionByName(n)


VALUE = "CAST(floor((CAST(embedding[d + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER)"
XY = f"vec_id % {ACROSS} * {TILE} + d % {TILE} AS x, vec_id // {ACROSS} * {TILE} + d // {TILE} AS y"

HEIGHT_SQL = f"(((SELECT max(vec_id) FROM embeddings) // {ACROSS} + 1) * {TILE})"

#: The same views in DuckDB's SQL.
SQL = {
    "mosaic": f"SELECT {XY}, {VALUE} AS value FROM embeddings, range(64) t(d)",
    "mosaic3": f"SELECT vec_id % 3 AS band, vec_id // 3 % {ACROSS3} * {TILE} + d % {TILE} AS x, vec_id // 3 // {ACROSS3} * {TILE} + d // {TILE} AS y, {VALUE} AS value FROM embeddings, range(64) t(d) WHERE vec_id < (SELECT count(*) // 3 * 3 FROM embeddings)",
    "frames": f"SELECT label AS frame, {XY}, {VALUE} AS value FROM embeddings, range(64) t(d)",
    "element": """SELECT o_custkey AS annotation, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'rectangle' WHEN 'F' THEN 'circle' ELSE 'point' END AS type,
        o_orderpriority AS grp, CAST(o_orderkey % 1000 * 10 AS DOUBLE) AS cx, CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS DOUBLE) AS cy,
        CAST(o_orderkey % 40 + 8 AS DOUBLE) AS width, CAST(o_orderkey % 40 + 8 AS DOUBLE) AS height, o_orderdate AS created,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders""",
    "history": "SELECT user_id AS annotation, event_id AS version, ts AS updated, event_type <> 'error' AS active, event_type AS kind FROM events",
    "item": "SELECT c_custkey AS item, c_name AS name, c_nationkey AS folder, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "folder": "SELECT 9999 AS folder, NULL::INTEGER AS parent, 'root' AS name UNION ALL SELECT r_regionkey + 1000, 9999, r_name FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name FROM nation",
}


def with_views(*names: str) -> str:
    """A WITH clause that defines some of the views."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
