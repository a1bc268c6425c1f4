"""From documents to packed training sequences: each stage reads what its predecessor wrote.

Counted as part of ``tidegrid.llm``. A stage takes (spark, docs, sf_dir), judges every row of ``docs``, and returns the
documents it keeps with the columns of ``documents``; the last returns pieces and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, free_name, keyed, table
from tidegrid.llm.decontam import contaminated
from tidegrid.llm.langid import held_out, identify
from tidegrid.llm.neardup import near_copies
from tidegrid.llm.packing import pack
from tidegrid.llm.secrets import MARK, find_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. The model learns from the labelled documents that operator 10 may learn from."""
    return identify(docs, docs.where(~held_out())).where(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id. Every row is judged by its own text, also
    rows without id and rows that share theirs (these come after all others, in an order of their own)."""
    key = free_name(docs, "_key")
    rows = keyed(docs, key)
    kept = near_copies(rows.select(F.col(key).alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias(key))
    return rows.join(cut(kept, "pipeline-kept"), key, "left_semi").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` is found. Every row is judged by its own text, as in :func:`near_duplicates`."""
    key = free_name(docs, "_key")
    rows = keyed(docs, key)
    found = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(cut(found, "leaks-found"), key, "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in them replaced by a mark and n_chars of the new text."""
    out = find_secrets(docs, mark=MARK)
    changed = F.size("spans") > 0
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can express none of the first, second, fourth and fifth stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
