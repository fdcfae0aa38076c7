"""Corpus pipeline: language, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and
returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralane.llm import language_id, near_dedup, packing, pii
from terralane.llm.common import documents, materialize, small_batches

#: The stages rest on compression, signatures and tokenization, which SQL lacks.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is certain; ``lang`` becomes the language found.

    Rejected are texts that are null or without letters and those whose two best
    languages compress alike.
    """
    small_batches(spark)
    models = language_id.learn(docs)
    judged = language_id.identify(docs, models)
    kept = judged.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred"))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, 0.8).

    Rows that repeat an id are one document, of which one row stays.
    """
    small_batches(spark)
    groups = near_dedup.near_duplicates(docs)
    kept = groups.where("kept").select("doc_id").distinct()
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    number = "n" + "_" * max(map(len, docs.columns))
    # What is kept grows with the corpus, so it is never broadcast.
    found = docs.join(kept.hint("merge"), "doc_id").withColumn(number, F.row_number().over(once))
    nameless = docs.where(F.col("doc_id").isNull())
    return found.where(F.col(number) == 1).drop(number).select(nameless.columns).unionByName(nameless)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays."""
    small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
