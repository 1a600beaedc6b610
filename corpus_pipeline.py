"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing by source, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
``documents``; the last returns the packed pieces. Stages are written as Parquet and read again, so a lost executor
costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeledger.llm import jaccard_join, line_templates, mixing, packing, toxicity
from tapeledger.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade stays below the limit."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.graded(docs, model)
    return scored.where(F.col("toxic_probability") < toxicity.REJECT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs across documents."""
    out = line_templates.drop_templates(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

# The classifier and the near-duplicate forest cannot be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
