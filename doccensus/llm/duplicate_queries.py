"""Queries of duplicate detection and decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.llm import decontamination, near_duplicates, passages, repeats
from doccensus.llm.shared import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}  # none of these methods can be stated in SQL; the tests hold them against brute force


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "covered", "n_tiles", "longest")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir, "doc_id", "text"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


QUERIES |= {"op1_near_duplicates": op1_near_duplicates, "op2_decontamination": op2_decontamination, "op9_passages": op9_passages, "op10_repeats": op10_repeats}
