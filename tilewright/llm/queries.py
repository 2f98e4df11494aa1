"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.html_extract import extract_pages
from tilewright.llm.langid import identify
from tilewright.llm.lm import score_documents
from tilewright.llm.mixing import taken_words
from tilewright.llm.media import store_media
from tilewright.llm.packing import pack_conversations, pack_documents
from tilewright.llm.quality import LIMITS, STOP_WORDS, score_quality
from tilewright.llm.simhash import near_duplicates
from tilewright.llm.substring import near_passages
from tilewright.llm.suffix_dedup import remove_repeats
from tilewright.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by near_duplicates(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by remove_repeats(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by taken_words(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return taken_words(_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by identify(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return identify(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by near_passages(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return near_passages(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by score_quality(); nulls, ties, repeats, long texts and empty tables as in its module."""
    scored = score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.selectExpr("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages`` by extract_pages(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by score_documents(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by store_media(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return store_media(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by pack_documents(); nulls, ties, repeats, long texts and empty tables as in its module."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``conversations``; op10 with a loss mask.  Cases as in pack_conversations()."""
    return pack_conversations(_table(spark, sf_dir, "conversations"))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LIMIT_SQL = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "exclamations_per_word": "length(regexp_replace(coalesce(text, ''), '[^!]+', '', 'g')) / greatest(n_words, 1)",
    "stop_word_ratio": "len(list_filter(words, lambda w: lower(trim(w, '.,;:!?\"''()')) IN ({}))) / greatest(n_words, 1)".format(", ".join(f"'{w}'" for w in STOP_WORDS)),
    "duplicate_line_ratio": "n_dup_lines / greatest(len(lines), 1)",
    "alphabetic_word_ratio": r"len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) / greatest(n_words, 1)",
}
_VERDICT_SQL = " AND ".join(
    part for name, least, most in LIMITS for part in ((f"{_LIMIT_SQL[name]} >= {least}" if least is not None else ""), (f"{_LIMIT_SQL[name]} <= {most}" if most is not None else "")) if part
)

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, text, {WORDS_SQL} AS words,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], chr(1)) AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) t(k) GROUP BY doc_id),
c AS (
  SELECT d.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_VERDICT_SQL} AS kept
FROM f
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, max(CASE WHEN ratio >= share THEN share END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN cap ELSE weight * level END AS target FROM v),
k AS (SELECT source, 8 + length(bin(size)) AS m, sum(size)::BIGINT AS w FROM d GROUP BY ALL),
x AS (
  SELECT k.source, m, w, source_size, target, coalesce(sum(w) OVER b, 0)::BIGINT AS capped, (sum(m * w) OVER a)::BIGINT AS open
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  WINDOW b AS (PARTITION BY k.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY k.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT *, CASE WHEN open > 0 THEN (target - 3.0::DOUBLE * capped) / open END AS tried FROM x),
z AS (SELECT *, arg_max(tried, m) FILTER (tried * m <= 3.0::DOUBLE) OVER (PARTITION BY source) AS level FROM y),
e AS (SELECT *, least(coalesce(level * m, 3.0::DOUBLE), 3.0::DOUBLE) AS expected FROM z),
g AS (SELECT *, floor(expected + 1e-9::DOUBLE)::BIGINT AS copies FROM e),
q AS (
  SELECT *, CASE WHEN expected - copies > 1e-9::DOUBLE THEN expected - copies ELSE 0.0::DOUBLE END AS inclusion,
         greatest(0, floor(target + 0.5::DOUBLE)::BIGINT - sum(copies * w) OVER (PARTITION BY source))::BIGINT AS words FROM g),
u AS (
  SELECT d.doc_id, d.size, q.*,
         ((('0x' || substr(md5('mix-1' || chr(31) || coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS r
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND 8 + length(bin(d.size)) = q.m),
o AS (
  SELECT *, (r / (1 - r)) / (greatest(inclusion, 1e-12::DOUBLE) / (1 - least(inclusion, (1 - 1e-12::DOUBLE)))) AS odds, d.size > 0 AND inclusion > 0 AS may FROM u AS d),
c AS (
  SELECT *, coalesce(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM o)
SELECT doc_id, size, source_size, target, copies, (copies * size + CASE WHEN may THEN least(size, greatest(0, words - prior)) ELSE 0 END)::BIGINT AS taken FROM c
"""

OP2_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n_bytes FROM b),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS i FROM n)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM g GROUP BY doc_id, run),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS p FROM r),
sp AS (
  SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN p = prev + 1 THEN 0 ELSE 1 END) AS n_spans
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -9) AS prev FROM cov) GROUP BY doc_id),
k AS (
  SELECT x.doc_id, string_agg(x.c, '' ORDER BY x.p) AS h
  FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(0, n_bytes)) AS p FROM n)) x
  ANTI JOIN cov ON x.doc_id = cov.doc_id AND x.p = cov.p GROUP BY x.doc_id)
SELECT n.doc_id, n.n_bytes, coalesce(sp.n_removed, 0)::BIGINT AS n_removed, coalesce(sp.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM n LEFT JOIN sp USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_langid": op4_langid,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality": op6_quality,
        "op7_html_extract": op7_html_extract,
        "op8_lm_score": op8_lm_score,
        "op9_media": op9_media,
        "op10_packing": op10_packing,
        "packing_conversations": packing_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_mixing": OP3_SQL, "op6_quality": OP6_SQL}
