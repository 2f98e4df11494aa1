"""Plottable tables out of cells (source, key, item, annotation, element, row, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTINCT = 20


def column_catalogue(cells: DataFrame, distinct: int = DISTINCT) -> DataFrame:
    """key, count, type, number range, and the distinct values of columns with few.

    A column is of numbers if every value is one.  The distinct values come from a two-step count,
    so a column with many never gathers them in one row.
    """
    cells = cells.where("value IS NOT NULL AND value <> ''")
    number = F.expr("try_cast(value AS double)")
    values = cells.groupBy("key", "value").agg(F.count("*").alias("n"))
    stats = values.groupBy("key").agg(F.sum("n").alias("count"), F.count("*").alias("n_distinct"), F.bool_and(number.isNotNull()).alias("numeric"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    few = stats.where(F.col("n_distinct") <= distinct).select("key")
    listed = values.join(few, "key").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("distinct_values"))
    out = stats.join(listed, "key", "left")
    return out.select("key", "count", F.when(F.col("numeric"), "number").otherwise("string").alias("type"), F.when(F.col("numeric"), F.col("lo")).alias("min"), F.when(F.col("numeric"), F.col("hi")).alias("max"), "n_distinct", "distinct_values")


def fill_from_parents(rows: DataFrame, values: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each row with a value a column: its own, or else that of the nearest level above.

    ``keys`` go from the coarsest to the finest; the tables in ``values`` have the keys (null below their
    level) and ``value``.  One equi-join for each level and column.
    """
    out = rows
    for name, table in values.items():
        levels: list[Column] = []
        for depth in range(len(keys), -1, -1):
            at = table
            for k in keys[:depth]:
                at = at.where(F.col(k).isNotNull())
            for k in keys[depth:]:
                at = at.where(F.col(k).isNull())
            found = f"{name}_{depth}"
            level = at.groupBy(*keys[:depth]).agg(F.min("value").alias(found))
            out = out.join(level, keys[:depth], "left") if depth else out.crossJoin(F.broadcast(level))
            levels.append(F.col(found))
        out = out.withColumn(name, F.coalesce(*levels)).drop(*[f"{name}_{d}" for d in range(len(keys) + 1)])
    return out
