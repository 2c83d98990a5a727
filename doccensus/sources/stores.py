"""Keyed stores with a lifetime: page knowledge, processed-content cache, reports.

Every time-dependent function takes ``now``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.functions import urls as U
from doccensus.functions.common import running_max

WEEK = 7
#: parts of a domain's entries by the hash of the URL; a write touches the parts of its URLs only
BUCKETS = 16


def _week_after(now: Column) -> Column:
    return now + F.make_dt_interval(F.lit(WEEK))


def live_entries(kb: DataFrame, now: Column, domain: str | None = None) -> DataFrame:
    """Unexpired entries, of one domain when given (a partition filter)."""
    kept = kb.filter(F.col("expires_at") > now)
    return kept if domain is None else kept.filter(F.col("domain") == domain)


def read_kb(spark: SparkSession, path: str, domain: str, now: Column) -> DataFrame:
    return live_entries(spark.read.parquet(path), now, domain).drop("bucket")


def upsert_kb(kb: DataFrame, new_pages: DataFrame, now: Column) -> DataFrame:
    """Store contents after a write: the newest row per (domain, url).

    New rows expire a week after ``now``; on equal crawl times they win, and of
    several old or new ones the greatest by its other columns, whatever the
    partitions. An aggregate with map-side reduction, keyed by page rather than
    by domain.
    """
    fresh = new_pages.withColumn("domain", U.kb_domain("url")).withColumn("expires_at", _week_after(now))
    both = kb.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [x for x in both.columns if x not in ("domain", "url", "_new")]
    newest = F.max_by(F.struct(*rest), F.struct("crawled_at", "_new", *rest)).alias("r")
    return both.groupBy("domain", "url").agg(newest).select("domain", "url", *[F.col("r")[x].alias(x) for x in rest])


def in_buckets(kb: DataFrame) -> DataFrame:
    return kb.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int"))


def write_kb(kb: DataFrame, path: str) -> None:
    """The store as folders by domain and, inside, by bucket of the URL."""
    in_buckets(kb).write.mode("overwrite").partitionBy("domain", "bucket").parquet(path)


def split_cached(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Mark each request hit or miss; an entry that ends exactly now still counts."""
    live = cache.filter(F.col("ttl") >= now).select(F.col("url").alias("_key"), "contextual_setting").distinct().withColumn("_hit", F.lit(True))
    keyed = requests.withColumn("_key", U.normalize_url("url"))
    return keyed.join(live, ["_key", "contextual_setting"], "left").withColumn(
        "cache_status", F.when(F.col("_hit").isNotNull(), "hit").otherwise("miss")
    ).drop("_hit").withColumnRenamed("_key", "cache_url")


def split_cached_at(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Mark each request hit or miss at its own time: an as-of join with the versions of the cached entry.

    ``requests`` (url, contextual_setting, ts, ...), ``versions`` (url as normalised, contextual_setting, processed_at, ttl).
    The version that counts is the last one made at or before the request; it is a hit if it had not ended by then. Both
    sides run through one ordered pass over (entry, time), which is spread over tasks even for a single hot entry.
    """
    entry = ["cache_url", "contextual_setting"]
    asked = requests.select(U.normalize_url("url").alias("cache_url"), "contextual_setting", F.col("ts").cast("timestamp").alias("_at"), F.lit(1).alias("_turn"), F.struct(*requests.columns).alias("_request"))
    made = versions.filter("url IS NOT NULL").select(
        F.col("url").alias("cache_url"), "contextual_setting", F.col("processed_at").cast("timestamp").alias("_at"), F.lit(0).alias("_turn"),
        F.struct(F.col("processed_at").cast("timestamp").alias("processed_at"), F.col("ttl").cast("timestamp").alias("ttl")).alias("_made"),
    )
    both = asked.unionByName(made, allowMissingColumns=True)
    known = running_max(both, entry, [F.col("_at"), F.col("_turn")], _latest=F.col("_made")).filter(F.col("_request").isNotNull())
    status = F.when(F.col("_latest.ttl") >= F.col("_at"), "hit").otherwise("miss")
    return known.select("_request.*", "cache_url", status.alias("cache_status"))


def cache_rows(pages: DataFrame, now: Column) -> DataFrame:
    """Cache index rows for processed pages (url, contextual_setting, markdown, content_type)."""
    key = U.cache_key("url", "contextual_setting")
    return pages.select(
        U.normalize_url("url").alias("url"), "contextual_setting", now.alias("processed_at"), F.sha2("markdown", 256).alias("content_hash"),
        F.concat(F.lit("sessions/"), key, F.lit("/processed-content.json")).alias("location"), _week_after(now).alias("ttl"), "content_type",
    )


def write_cache(pages: DataFrame, path: str, now: Column) -> None:
    cache_rows(pages, now).write.mode("append").parquet(path)


def report_documents(df: DataFrame, key: str = "page_id") -> DataFrame:
    """One JSON document per row."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
