"""Items, folders, metadata: recursion, grouping, search and phrase filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def descendants(folders: DataFrame, root: int) -> DataFrame:
    """The folders below ``root``, itself included; a level at a time, until one has no new folder.
    Folders met before are left out of a level, so that a cycle ends."""
    found = level = folders.where(F.col("folder") == root).select("folder").distinct()
    while not level.isEmpty():
        below = folders.join(level.select(F.col("folder").alias("parent")), "parent").select("folder").distinct()
        level = below.join(found, "folder", "left_anti")
        found = found.unionByName(level)
    return found


def first_of_group(df: DataFrame, key: str, order: list[str], counts: list[str] = ()) -> DataFrame:
    """The first row of each group in an order, with the group's size and distinct counts."""
    best = F.min_by(F.struct("*"), F.struct(*order)).alias("row")
    return df.groupBy(F.col(key).alias("group_key")).agg(best, F.count("*").alias("group_size"), *[F.countDistinct(c).alias(f"n_{c}") for c in counts])


def skip_newest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """All rows of a key but its first ``n``."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") > n).drop("place")


def number_step(text: str) -> tuple[float, float] | None:
    """A phrase as a number and one unit of its last digit; None if it isn't one."""
    try:
        value = float(text)
    except ValueError:
        return None
    digits = repr(value).lower()
    if "e" in digits:
        return value, 0.0
    whole, _, part = digits.lstrip("-").partition(".")
    part = part.rstrip("0")
    if part:
        return value, 10.0 ** -len(part)
    zeros = len(whole) - len(whole.rstrip("0"))
    return value, float(10**zeros) if whole.strip("0") else 0.0


_PHRASE = re.compile(r"""(?:(?P<key>\w+):)?(?P<not>-)?(?P<values>(?:"[^"]*"|'[^']*'|[^\s,"']+)(?:,(?:"[^"]*"|'[^']*'|[^\s,"']+))*)""")
_VALUE = re.compile(r""""([^"]*)"|'([^']*)'|([^\s,"']+)""")


def parse_filter(text: str) -> list[tuple[str | None, bool, list[tuple[str, bool]]]]:
    """Terms of a list filter: (column, negated, [(value, exact)]).

    Terms are split by spaces; ``column:`` restricts one, ``-`` negates it, commas are
    alternatives, and double quotes ask for the whole value.
    """
    out = []
    for m in _PHRASE.finditer(text):
        values = [(a or b or c, bool(a)) for a, b, c in _VALUE.findall(m["values"])]
        term = (m["key"], bool(m["not"]), values)
        if values and term not in out:
            out.append(term)
    return out


def phrase_match(column: Column, number: Column | None, value: str, exact: bool) -> Column:
    """A value within a text column (any case), or a number within one unit of its last digit."""
    found = F.lower(column) == value.lower() if exact else F.lower(column).contains(value.lower())
    step = number_step(value)
    if step and number is not None:
        v, d = step
        found = found | (number == v)
        if not exact and v > 0 and d:
            found = found | ((number >= v) & (number < v + d))
        elif not exact and v < 0 and d:
            found = found | ((number <= v) & (number > v + d))
    return F.coalesce(found, F.lit(False))


def list_filter(text: str, columns: dict[str, tuple[Column, Column | None]]) -> Column:
    """The predicate of a list filter over named columns (as text, and as a number or None)."""
    ok = F.lit(True)
    for key, negated, values in parse_filter(text):
        used = [c for n, c in columns.items() if key is None or n.lower() == key.lower()]
        hit = F.lit(False)
        for value, exact in values:
            for as_text, as_number in used:
                hit = hit | phrase_match(as_text, as_number, value, exact)
        ok = ok & (~hit if negated else hit)
    return ok


def name_match(name: Column, text: str) -> Column:
    """Whether a name or one of its parts (split at anything but letters and digits) begins with a
    text, in any case."""
    t = text.lower()
    return F.lower(name).startswith(t) | F.exists(F.split(F.lower(name), r"(?U)[\W_]+"), lambda p: p.startswith(t))


def set_metadata(current: Column, changes: Column, allow_null: bool = False) -> Column:
    """A map with another's entries set; null values delete unless they are allowed."""
    kept = F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(changes), k))
    merged = F.map_concat(kept, changes)
    return merged if allow_null else F.map_filter(merged, lambda _, v: v.isNotNull())


def delete_metadata(current: Column, keys: list[str]) -> Column:
    return F.map_filter(current, lambda k, _: ~k.isin(keys))
