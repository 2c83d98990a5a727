"""Usage, access, feedback and progress logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import c, first_per, top_k, trim_ws


def daily_usage(events: DataFrame) -> DataFrame:
    """Analyses per client and UTC day; a refund never takes the count below 0.

    The clamp depends on event order, so a plain sum is wrong when a refund
    comes first. A clamped walk ends at ``total - min(0, lowest prefix)``;
    totals and lowest prefixes are built per minute and then per day, so the
    busiest client's day is never ordered in one task.
    """
    placed = events.withColumn("day", F.to_date("ts")).withColumn("_m", F.date_trunc("minute", "ts"))
    walk = Window.partitionBy("ip_hash", "day", "_m").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    minutes = placed.withColumn("_prefix", F.sum("delta").over(walk)).groupBy("ip_hash", "day", "_m").agg(
        F.sum("delta").alias("total"), F.min("_prefix").alias("low")
    )
    before = Window.partitionBy("ip_hash", "day").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    shifted = minutes.withColumn("low", F.col("low") + F.coalesce(F.sum("total").over(before), F.lit(0)))
    return shifted.groupBy("ip_hash", "day").agg((F.sum("total") - F.least(F.lit(0), F.min("low"))).alias("used"))


def daily_usage_net(events: DataFrame) -> DataFrame:
    """Starts minus refunds per client and day, floored at 0 once per day."""
    return events.groupBy("ip_hash", F.to_date("ts").alias("day")).agg(F.greatest(F.lit(0), F.sum("delta")).alias("used"))


def rate_decision(usage: DataFrame, waitlist: DataFrame) -> DataFrame:
    """Daily allowance of every client: base limit, raised for waitlisted ones."""
    listed = waitlist.select("ip_hash").distinct().withColumn("_w", F.lit(True))
    joined = usage.join(listed, "ip_hash", "left")
    waitlisted = F.col("_w").isNotNull()
    limit = F.when(waitlisted, K.DAILY_LIMIT + K.WAITLIST_BONUS).otherwise(K.DAILY_LIMIT).cast("long")
    return joined.select(
        "ip_hash", "day", "used", limit.alias("daily_limit"), waitlisted.alias("waitlisted"), (F.col("used") < limit).alias("allowed"),
        F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"),
    )


def allowed_events(events: DataFrame, waitlist: DataFrame) -> DataFrame:
    """The requests of each day that pass the limit, in order of arrival.

    Ranked inside salted parts first: a busy client sends at most
    ``salts * limit`` rows to its final ranking.
    """
    most = K.DAILY_LIMIT + K.WAITLIST_BONUS
    first = top_k(
        events.withColumn("day", F.to_date("ts")), ["ip_hash", "day"], [F.col("ts"), F.col("event_id")], most, ["event_id"], rank="nth"
    )
    listed = waitlist.select("ip_hash").distinct().withColumn("_w", F.lit(True))
    limit = F.when(F.col("_w").isNotNull(), most).otherwise(K.DAILY_LIMIT)
    return first.join(listed, "ip_hash", "left").filter(F.col("nth") <= limit).select(
        "event_id", "ip_hash", "day", F.col("nth").cast("long").alias("nth")
    )


def clean_email(col: Column | str) -> Column:
    return F.lower(trim_ws(c(col)))


def login_sessions(access: DataFrame) -> DataFrame:
    """One row per attempt, marked verified when its confirmation arrived.

    A confirmation without an attempt still makes a verified row.
    """
    rows = access.withColumn("email", clean_email("email"))
    attempt = F.col("action") == "attempt"
    return rows.groupBy("email", "login_ts").agg(
        F.max_by(F.when(attempt, F.coalesce("user_agent", F.lit("unknown"))), F.when(attempt, F.col("event_id"))).alias("user_agent"),
        F.when(F.bool_or(~attempt), "verified").otherwise("attempted").alias("status"),
        F.max(F.when(~attempt, F.col("ts"))).alias("verified_at"),
    )


def waitlist_first(signups: DataFrame) -> DataFrame:
    """First sign-up of every client."""
    return first_per(signups, ["ip_hash"], [F.col("ts"), F.col("event_id")], ["event_id", "email"])


def clean_feedback(rows: DataFrame) -> DataFrame:
    """Non-empty messages with every field trimmed and cut to its limit."""
    message = trim_ws(F.col("message"))
    return rows.filter(message != "").select(
        "feedback_id", F.substring(message, 1, 2000).alias("message"), F.substring(trim_ws(F.col("email")), 1, 200).alias("email"),
        F.substring("audit_url", 1, 500).alias("audit_url"), F.substring("page_url", 1, 500).alias("page_url"),
    )


def audit_rollup(log: DataFrame) -> DataFrame:
    """Audits per day and outcome with score and duration statistics."""
    return log.groupBy(F.to_date("submitted_at").alias("day"), "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("audits"), F.avg("overall_score").alias("mean_score"), F.min("overall_score").alias("min_score"),
        F.max("overall_score").alias("max_score"), F.avg("analysis_ms").alias("mean_ms"), F.max("analysis_ms").alias("max_ms"),
    )


def latest_category_result(progress: DataFrame) -> DataFrame:
    """Last category result of every session and category."""
    results = progress.filter(F.col("type") == "category-result")
    last = F.max_by(F.struct("message", "data"), F.struct("ts", "event_id")).alias("last")
    return results.groupBy("session_id", "category").agg(last).select("session_id", "category", "last.message", "last.data")


TRUNCATION_NOTE = "Payload too large - full data available in the session artifact"


def cap_payload(progress: DataFrame, limit: int = K.MAX_PAYLOAD_BYTES) -> DataFrame:
    """Replace ``data`` by a marker where the JSON message exceeds the limit in bytes."""
    size = F.octet_length(F.to_json(F.struct(*progress.columns)))
    marker = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.lit(TRUNCATION_NOTE).alias("message")))
    return progress.withColumn("_big", size > limit).withColumn("data", F.when(F.col("_big"), marker).otherwise(F.col("data"))).withColumnRenamed(
        "_big", "truncated"
    )


def phase_durations(progress: DataFrame) -> DataFrame:
    """Milliseconds from each phase event to the next one of its session.

    The next event is looked up inside the hour; only the last event of an
    hour needs the first of the following one, taken from a small summary.
    """
    placed = progress.withColumn("_h", F.date_trunc("hour", "ts"))
    firsts = placed.groupBy("session_id", "_h").agg(F.min("ts").alias("_first"))
    ahead = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy("session_id").orderBy("_h"))).drop("_first")
    inside = F.lead("ts").over(Window.partitionBy("session_id", "_h").orderBy("ts", "event_id"))
    joined = placed.withColumn("_in", inside).join(ahead, ["session_id", "_h"])
    until = F.coalesce("_in", "_next")
    return joined.select(
        "event_id", "session_id", "phase", F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000).alias("duration_ms")
    )


def expire(df: DataFrame, ts: str, now: Column, days: int = 7) -> DataFrame:
    """Rows whose lifetime has not ended at ``now``; an exact end is still alive."""
    return df.filter(F.col(ts) + F.make_dt_interval(F.lit(days)) >= now)
