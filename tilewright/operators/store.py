"""Changes of an annotation store as plans: new versions of elements, removal, copies and access lists.

A store is two tables, annotations and elements.  Nothing is changed in place: every call gives the
rows that a table has after it, or the rows to add and to remove, so a write can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ, WRITE, ADMIN = 0, 1, 2


def update_elements(stored: DataFrame, new: DataFrame, version: Column, by: str = "annotation") -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows to remove): elements of ``new`` take the place of all that their annotations have.

    Added rows get the version; removed ones are those of a smaller version, so readers of the old
    version are served until the removal.
    """
    added = new.withColumn("version", version.cast("long"))
    changed = new.select(by).distinct()
    removed = stored.join(changed, by, "left_semi").where(F.col("version") < version)
    return added, removed


def after_update(stored: DataFrame, added: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """The element table after both: one anti-join on the key and version."""
    return stored.join(removed.select(*key, "version"), [*key, "version"], "left_anti").unionByName(added, allowMissingColumns=True)


def remove_where(stored: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet a condition; rows for which it is unknown stay."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def remove_annotations(annotations: DataFrame, gone: DataFrame, key: str = "annotation") -> DataFrame:
    """Annotations marked inactive; the rows stay for the history."""
    marked = gone.select(key).distinct().withColumn("gone", F.lit(True))
    return annotations.join(marked, key, "left").withColumn("active", F.col("active") & F.coalesce(~F.col("gone"), F.lit(True))).drop("gone")


def save_version(history: DataFrame, changed: DataFrame, key: str = "annotation") -> DataFrame:
    """The history with one more version of each changed annotation: the greatest version of its own so far and one."""
    last = history.groupBy(key).agg(F.max("version").alias("last"))
    rows = changed.join(last, key, "left").withColumn("version", F.coalesce(F.col("last"), F.lit(0)) + 1).drop("last")
    return history.unionByName(rows, allowMissingColumns=True)


def copy_annotations(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Annotations of items as annotations of others; pairs: (item, target).  ``origin`` names the one copied."""
    return annotations.join(pairs, "item").select(F.col("target").alias("item"), F.col("annotation").alias("origin"), *[c for c in annotations.columns if c not in ("item", "annotation")])


def level_of(access: Column, user: Column, groups: Column, public: Column) -> Column:
    """Highest access level of a user: of their own entry, of their groups, read if public, else -1.
    access: array of struct(kind, id, level)."""
    own = F.filter(access, lambda a: ((a["kind"] == "user") & (a["id"] == user)) | ((a["kind"] == "group") & F.array_contains(groups, a["id"])))
    best = F.array_max(F.transform(own, lambda a: a["level"]))
    return F.greatest(F.coalesce(best, F.lit(-1)), F.when(F.coalesce(public, F.lit(False)), READ).otherwise(-1))


def set_access(current: Column, changes: Column) -> Column:
    """An access list with entries replaced by kind and id; a null level removes one."""
    kept = F.filter(current, lambda a: ~F.exists(changes, lambda c: (c["kind"] == a["kind"]) & (c["id"] == a["id"])))
    return F.array_sort(F.filter(F.concat(kept, changes), lambda a: a["level"].isNotNull()))


def inherited_access(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """Annotations without an access list take their item's."""
    there = items.select("item", F.col("access").alias("item_access"))
    return annotations.join(there, "item", "left").withColumn("access", F.coalesce("access", "item_access")).drop("item_access")


def same_structure(a: Column, b: Column) -> Column:
    """Whether two element documents (JSON) have the same keys at their top, apart from ids and labels."""
    keys = lambda c: F.array_sort(F.array_except(F.json_object_keys(c), F.array(F.lit("id"), F.lit("label"))))
    return F.coalesce(keys(a) == keys(b), F.lit(False))
