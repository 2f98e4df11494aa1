"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is
written as Parquet before the next one reads it.  An empty table passes through every stage; columns other than
doc_id, text, source and n_chars are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.mixing import mixed_documents
from tilewright.llm.packing import pack_documents
from tilewright.llm.quality import filter_quality
from tilewright.llm.simhash import keep_one
from tilewright.llm.storage import materialize
from tilewright.llm.suffix_dedup import remove_repeats
from tilewright.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept.  Null and empty texts go; repeated rows stay or go together."""
    return filter_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies.  Rows of equal id stay together; rows without an
    id, and texts without words but for the first of these, are left as they are or linked as in simhash.py."""
    ship(spark)
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document has; n_chars follows the text.  Every row stays; null texts stay null,
    rows of equal id never remove from one another, rows without an id stand last."""
    ship(spark)
    cleaned = remove_repeats(docs, keep_text=True)
    text = F.when(F.col("n_bytes") > 0, F.col("kept"))
    columns = {"text": text, "n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")}
    return cleaned.select(*[columns[c].alias(c) if c in columns else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources share the words by weight.  A null source is one of its own, the last; texts
    without words are taken no times; equal rows are taken in any order."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048.  Null texts are the end id alone; rows of equal id are packed one by one."""
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("simhash", simhash_near_dedup),
    ("suffix_dedup", suffix_array_dedup),
    ("mixing", mix_to_weights),
    ("packing", packing),
]

#: SQL has no suffix order over bytes, fingerprints or tokenizers at this speed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
