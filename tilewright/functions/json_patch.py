"""JSON patches on a column of JSON text, a batch at a time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _place(entries: list, name: str) -> int:
    """Index of a list's entry by number or by id."""
    if name.startswith("id:"):
        return next(k for k, x in enumerate(entries) if isinstance(x, dict) and str(x.get("id")) == name[3:])
    place = int(name)
    if not 0 <= place <= len(entries):
        raise IndexError(name)
    return place


def apply_patch(text: str | None, patch: str | None) -> str | None:
    """``text`` after a list of add, replace and remove operations; None for a bad one.

    In a list ``id:<id>`` names the entry whose id it is, as in ``/elements/id:7/label``.  What is there can't be added, and
    what isn't there can't be replaced or removed.
    """
    try:
        root = {"": json.loads(text)}
        for step in json.loads(patch):
            *way, last = [k.replace("~1", "/").replace("~0", "~") for k in ("" + step["path"]).split("/")]
            at = root
            for k in way:
                at = at[_place(at, k)] if isinstance(at, list) else at[k]
            op = step["op"]
            if op not in ("add", "replace", "remove"):
                return None
            if isinstance(at, list):
                k = len(at) if last == "-" else _place(at, last)
                if op == "add":
                    at.insert(k, step["value"])
                elif op == "replace":
                    at[k] = step["value"]
                else:
                    del at[k]
            elif op == "remove":
                del at[last]
            elif (op == "replace") != (last in at):
                return None
            else:
                at[last] = step["value"]
        return json.dumps(root[""], sort_keys=True, ensure_ascii=False)
    except (KeyError, IndexError, ValueError, TypeError, StopIteration):
        return None


def patched(text: Column, patch: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([apply_patch(x, y) for x, y in zip(a, b, strict=True)])

    return run(text, patch)
