"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Rows keep all columns of documents up to the last stage, which returns pieces of token windows. An empty table goes
through with no rows; what each stage makes of nulls, empty and very long texts, ties and repeated rows is stated in its
operator. The near-duplicate and suffix-array stages cannot be stated in SQL, so there is no ``ORACLE_SQL``; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doccensus.llm import decontamination, near_duplicates, packing, repeats, rules
from doccensus.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the first one of least doc_id."""
    return near_duplicates.keep_one(docs)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes that strings of 200 bytes with another place of their own cover.

    A passage of over 50 words has 200 bytes or more as long as its words have three letters on average.
    """
    return repeats.cut_repeats(docs, repeats.PASSAGE, repeats.PASSAGE_SLACK, repeats.PASSAGE_BLOCK)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in windows of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicate_stage),
    ("suffix array", suffix_array_stage),
    ("decontamination", decontamination_stage),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
