"""Readers: declared schemas, no inference, filters left to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.functions.common import c

FETCH_LOG_SCHEMA = (
    "page_url STRING, url STRING, purpose STRING, method STRING, status_code INT, failure STRING, "
    "content_type STRING, duration_ms BIGINT, ts TIMESTAMP"
)
ISSUE_SCHEMA = (
    "number BIGINT, title STRING, body STRING, html_url STRING, labels ARRAY<STRUCT<name: STRING>>, created_at TIMESTAMP, "
    "comments INT, reactions STRUCT<total_count: INT>, state STRING, pull_request STRUCT<url: STRING>"
)
CURATED_SCHEMA = (
    "ARRAY<STRUCT<id: STRING, title: STRING, category: STRING, description: STRING, frequency: INT, sources: ARRAY<STRING>, "
    "lastSeen: DATE, severity: STRING, relatedPages: ARRAY<STRING>>>"
)


def settle_redirects(pages: DataFrame) -> DataFrame:
    """The address a page ended at replaces the one asked for."""
    return pages.withColumn("url", F.coalesce("final_url", "url")) if "final_url" in pages.columns else pages


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return settle_redirects(spark.read.parquet(path))


def read_site_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Site files of one kind; ``kind`` is a partition or a pushed-down filter."""
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("status_code").between(200, 299)))


def read_fetch_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(FETCH_LOG_SCHEMA).parquet(path)


def clean_issues(raw: DataFrame) -> DataFrame:
    """Flat issue columns; pull requests are dropped."""
    return raw.filter(F.col("pull_request").isNull()).select(
        "number", "title", F.coalesce("body", F.lit("")).alias("body"), "html_url",
        F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"),
        "created_at", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce("reactions.total_count", F.lit(0)).alias("reactions"), "state",
    )


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return clean_issues(spark.read.schema(ISSUE_SCHEMA).json(path))


def parse_issue_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Issues from a column of JSON documents."""
    return clean_issues(lines.select(F.from_json(column, ISSUE_SCHEMA).alias("i")).select("i.*"))


def company_key(name: Column | str, domain: Column | str) -> Column:
    """Key of a company: its name, else a known domain, else the first domain label."""
    d = c(domain)
    return F.lower(
        F.coalesce(
            F.nullif(c(name), F.lit("")),
            F.when(d.contains("resend.com"), "resend").when(d.contains("liveblocks.io"), "liveblocks").when(d.contains("knock.app"), "knock"),
            F.substring_index(d, ".", 1),
        )
    )


def parse_curated_issues(files: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON objects keyed by company; values that are not lists are skipped."""
    keyed = files.select(F.explode(F.from_json(column, "map<string,string>")).alias("company", "text"))
    lists = keyed.filter(F.col("text").startswith("["))
    return lists.select("company", F.inline(F.from_json("text", CURATED_SCHEMA)))


def read_curated_issues(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    rows = parse_curated_issues(spark.read.text(path, wholetext=True))
    return rows if keys is None else rows.join(keys, "company", "left_semi")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
