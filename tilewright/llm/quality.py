"""Quality rules: one table of limits compiled into Spark projections.

Words are runs of characters that aren't space or U+0009..U+000D; lines are parts
between newlines.  Null and empty texts have no words and fail.  Nothing but
built-in expressions is used: rows are judged alone, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is that it was for on with as at by be this are or an from "
    "le la les de des et en un une que qui du dans pour par au sur il elle est pas "
    "der die das und ist den von zu mit sich dem auf ein eine im nicht "
    "el los las y del se con una no su lo es como más pero sus"
).split()

#: (ratio, least, most): a text outside any of the limits is rejected.
LIMITS = (
    ("mean_word_chars", 2.5, 12.0),
    ("symbols_per_word", None, 0.1),
    ("exclamations_per_word", None, 0.5),
    ("stop_word_ratio", 0.06, None),
    ("duplicate_line_ratio", None, 0.5),
    ("alphabetic_word_ratio", 0.7, None),
)


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for none."""
    body = F.btrim(text, F.lit(WHITE))
    return F.when(text.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+", -1))


def with_parts(df: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns), ``text`` and what the measures are made of."""
    text = F.col("text")
    parts = df.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text")).withColumn("words", words_of(text))
    parts = parts.withColumn("lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    parts = parts.withColumn("n", F.size("words"))
    window = F.transform(F.sequence(F.lit(1), F.col("n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    parts = parts.withColumn("windows", F.when(F.col("n") > WINDOW, window))
    # Only texts with a repeated window need the order of their windows.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    parts = parts.withColumn("placed", F.when(again, placed))
    near = lambda x, i: F.coalesce((F.get("placed", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get("placed", i + 1)["h"] == x["h"]), F.lit(False))
    return parts.withColumn("at", F.array_sort(F.transform(F.filter("placed", near), lambda x: x["i"])))


def base_columns() -> dict[str, Column]:
    """The exact counts, from the columns of with_parts()."""
    covered = WINDOW + F.aggregate(
        F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.least(F.lit(WINDOW), F.get("at", i) - F.get("at", i - 1))), F.lit(0), lambda a, x: a + x
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "n_words": F.col("n").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("at") > 1, covered).otherwise(F.lit(0)).cast("long"),
    }


def ratios() -> dict[str, Column]:
    """The measures of LIMITS, from base_columns() and the parts."""
    per_word = lambda c: c / F.greatest(F.col("n_words"), F.lit(1))
    stop = F.size(F.filter(F.transform("words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))), lambda w: w.isin(STOP_WORDS)))
    return {
        "mean_word_chars": per_word(F.col("word_chars")),
        "symbols_per_word": per_word(F.col("n_symbols")),
        "exclamations_per_word": per_word(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^!]+", ""))),
        "stop_word_ratio": per_word(stop),
        "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("lines"), F.lit(1)),
        "alphabetic_word_ratio": per_word(F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))),
    }


def verdict(limits=LIMITS) -> Column:
    """The table of limits as one boolean expression."""
    measures, ok = ratios(), F.lit(True)
    for name, least, most in limits:
        if least is not None:
            ok = ok & (measures[name] >= least)
        if most is not None:
            ok = ok & (measures[name] <= most)
    return ok


def score_quality(df: DataFrame, text_col: str = "text", limits=LIMITS) -> DataFrame:
    """``row`` (the input's columns as a struct) with the counts and the verdict:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    counted = with_parts(df, text_col).withColumns(base_columns())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(verdict(limits))
    # Each row goes through an array of one: a later filter would otherwise be pushed below the
    # projections, with every measure copied into the lambdas that use it.
    scored = F.struct("row", *base_columns(), failed.alias("base_failed"), kept.alias("kept"))
    return counted.select(F.explode(F.array(scored)).alias("scored")).select("scored.*")


def filter_quality(df: DataFrame, text_col: str = "text", limits=LIMITS) -> DataFrame:
    """The rows of ``df`` that pass, with its columns."""
    return score_quality(df, text_col, limits).where("kept").select("row.*")
