"""Streaming forms of the batch operators.

The event time is the arrival time of a request. Rows later than the
watermark are dropped; the batch forms have no such rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from doccensus.functions import urls as U
from doccensus.functions.common import settled, shared_folder
from doccensus.sources import stores


DAY_MS = 86_400_000


def daily_usage_stream(events: DataFrame) -> DataFrame:
    """Starts per client and day (UTC), a refund never taking the count below 0; final a day after the day ends.

    Equals ``daily_usage`` whatever the batches: the state of an open day is the list of its moves, as many as one client
    makes in a day, which is sorted and folded once the watermark has passed. The list is an aggregate of the JVM; no
    row goes through Python.
    """
    move = F.struct("ts", "event_id", "delta")
    days = events.withWatermark("ts", "1 day").groupBy("ip_hash", F.window("ts", "1 day").alias("span")).agg(F.collect_list(move).alias("moves"))
    none = F.lit(0).cast("long")
    used = F.aggregate(F.array_sort("moves"), none, lambda n, m: F.greatest(none, n + m["delta"]))
    return days.select("ip_hash", F.to_date("span.start").alias("day"), used.alias("used"))


def latest_heads_stream(log: DataFrame) -> DataFrame:
    """Last HEAD answer of every URL and day by event time, for update mode.

    A row that comes late changes its own day only. A day's state ends a day after it, so what is held is bounded by the URLs
    asked in two days, however many there ever were. ``latest_heads`` reads the newest answer of each URL.
    """
    at = F.struct("ts", "event_id")
    days = log.filter(F.col("method") == "HEAD").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("span"), "domain", "url")
    last = days.agg(F.max_by(F.struct("status_code", "failure"), at).alias("answer"), F.max(at).alias("at"))
    return last.select("domain", "url", F.col("span.start").alias("since"), "answer", "at")


def latest_heads(updates: DataFrame) -> DataFrame:
    """The rows of ``latest_heads_stream``, in any order and repeated or not, as a log with one HEAD row for each URL."""
    newest = updates.groupBy("domain", "url").agg(F.max_by("answer", "at").alias("answer"), F.max("at").alias("at"))
    return newest.select("domain", "url", F.lit("HEAD").alias("method"), "answer.status_code", "answer.failure", "at.ts", "at.event_id")


def first_requests_stream(requests: DataFrame, days: int = 7) -> DataFrame:
    """(session_key, ts) of requests that find no live copy: one that is ``days`` old or more is made anew.

    Decided by event time with one time stamp of state for each key, so the rows do not depend on the batches as long
    as these come in the order of time.
    """
    keyed = requests.withColumn("session_key", U.cache_key("url", "contextual_setting")).select("session_key", "ts")
    span = days * DAY_MS

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        times = pd.concat([f["ts"] for f in frames]).sort_values()
        made = []
        for t in times:
            ms = t.value // 1_000_000
            if first is None or ms >= first + span:
                first = ms
                made.append(t)
        state.update((first,))
        state.setTimeoutTimestamp(max(first + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_key": [key[0]] * len(made), "ts": made})

    return keyed.withWatermark("ts", "1 day").groupBy("session_key").applyInPandasWithState(
        fold, "session_key string, ts timestamp", "first long", "append", GroupStateTimeout.EventTimeTimeout
    )


def probe_ok_stream(log: DataFrame, expected: DataFrame) -> DataFrame:
    """Probe outcomes from a stream of answers and the static table of expected types.

    ``expected`` has one row per purpose, seven in all, so the static side is a
    fixed-size broadcast. Stateless.
    """
    typed = log.join(F.broadcast(expected.select("purpose").distinct().withColumn("_typed", F.lit(True))), "purpose", "left")
    soft_404 = F.col("_typed").isNotNull() & F.coalesce("content_type", F.lit("")).contains("text/html")
    return typed.withColumn("ok", F.col("status_code").between(200, 299) & ~soft_404).drop("_typed")


def read_current_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_kb_sink(path: str, now: Column) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` target that merges page summaries into the store at ``path``, laid out as by ``write_kb``.

    Only the (domain, bucket) folders of the batch's URLs are read, merged and overwritten, after the merged rows have been
    written to the shared folder; so a write into a domain that holds a third of the store touches as many buckets as
    it has URLs. A repeated batch ends in the same state.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = stores.in_buckets(batch.withColumn("domain", U.kb_domain("url")))
        try:
            old = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = fresh.limit(0).withColumn("expires_at", now)
        touched = fresh.select("domain", "bucket").distinct()
        old = old.join(touched, ["domain", "bucket"], "left_semi").select(*fresh.columns, "expires_at").drop("bucket")
        merged = settled(stores.upsert_kb(old, fresh.drop("domain", "bucket"), now))
        stores.in_buckets(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "bucket").parquet(path)

    return merge


def latest_category_stream(progress: DataFrame) -> DataFrame:
    """Latest result per session and category, for update mode."""
    last = F.max_by(F.struct("message", "data"), F.struct("ts", "event_id")).alias("last")
    results = progress.filter(F.col("type") == "category-result").groupBy("session_id", "category").agg(last)
    return results.select("session_id", "category", "last.message", "last.data")


def drain_to_table(df: DataFrame, name: str) -> DataFrame:
    """Process what is there in append mode and read the written rows back."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def drain_updates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process what is there in update mode; the last update of every key.

    Every batch writes its updates under its own number, so a repeated batch
    overwrites itself.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [x for x in df.columns if x not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return spark.read.parquet(f"{folder}/out").groupBy(*keys).agg(last).select(*keys, "last.*")
