"""Registered queries that run the streaming forms over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import shared_folder
from doccensus.operators import probes as P
from doccensus.plans import logs_queries as LQ
from doccensus.plans import oracle_frag as D
from doccensus.plans import sites_queries as SQ
from doccensus.plans import urls_queries as UQ
from doccensus.plans.inputs import derived_from, oracle_table, spark_table
from doccensus.sources import stores as ST
from doccensus.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict = {}


def stream(spark, sf_dir, table, name=None):
    """A given table, one file or a folder of files, as a stream, optionally turned into one of the derivations."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # a stream reads folders; as a pattern the path may also be that of a file
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")
    if "ts" in raw.columns:
        raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return raw if name is None else derived_from(spark, name, **{table: raw})


def _ss1(spark, sf):
    out = J.drain_to_table(J.daily_usage_stream(stream(spark, sf, "events", "usage_events")), "daily-usage")
    return out.withColumn("day", F.col("day").cast("string"))


QUERIES["ss1_daily_usage_stream"] = _ss1
# a day is final once the latest event is a day past its end
ORACLE["ss1_daily_usage_stream"] = f"""SELECT * FROM ({LQ.ORACLE['o1_daily_usage']}) WHERE CAST(day AS DATE) + INTERVAL 2 DAY < (SELECT max(ts) FROM events)"""

_LINKS = oracle_table("link_log")


def _ss2(spark, sf):
    requests = stream(spark, sf, "events", "link_log").select("ts", "url", F.lit("with-context").alias("contextual_setting"))
    made = J.drain_to_table(J.first_requests_stream(requests), "first-requests")
    return made.select("session_key", F.unix_millis("ts").alias("ms"))


QUERIES["ss2_first_requests_stream"] = _ss2
# a fold over the times of each key: one a week or more after the last kept one is kept
ORACLE["ss2_first_requests_stream"] = f"""SELECT session_key, unnest(kept) AS ms FROM (SELECT session_key,
  list_reduce(list([t] ORDER BY t), lambda a, x: CASE WHEN x[1] >= a[-1] + 7 * 86400000 THEN list_concat(a, x) ELSE a END) AS kept
  FROM (SELECT 'session-' || left(sha256(url || '#with-context'), 12) AS session_key, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS t FROM {_LINKS}) GROUP BY session_key)"""

_PURPOSE = "CASE event_id % 4 WHEN 0 THEN 'llms.txt' WHEN 1 THEN 'mcp.json' WHEN 2 THEN 'content-negotiation' ELSE 'direct-md' END"
_CTYPE = "CASE WHEN event_id % 3 = 0 THEN 'text/html; charset=utf-8' WHEN event_id % 3 = 1 THEN 'text/plain' ELSE NULL END"


def _ss3(spark, sf):
    log = stream(spark, sf, "events", "link_log").select("event_id", F.expr(_PURPOSE).alias("purpose"), F.expr(_CTYPE).alias("content_type"), "status_code")
    expected = spark.createDataFrame([(p, t) for p, ts in K.EXPECTED_CONTENT_TYPES.items() for t in ts], "purpose string, content_type string")
    return J.drain_to_table(J.probe_ok_stream(log, expected).select("event_id", "purpose", "ok"), "probe-ok")


QUERIES["ss3_probe_ok_stream"] = _ss3
ORACLE["ss3_probe_ok_stream"] = f"""SELECT event_id, purpose, status_code BETWEEN 200 AND 299 AND NOT (purpose IN ({D.q(K.EXPECTED_CONTENT_TYPES)}) AND contains(coalesce(ct, ''), 'text/html')) AS ok
  FROM (SELECT event_id, {_PURPOSE} AS purpose, {_CTYPE} AS ct, status_code FROM {_LINKS})"""


def _ss3_sitemaps(spark, sf):
    updates = J.drain_updates(J.latest_heads_stream(stream(spark, sf, "events", "link_log")), "latest-heads", ["domain", "url", "since"])
    return P.classify_sitemap_url(J.latest_heads(updates))


QUERIES["ss3_sitemap_state_stream"] = _ss3_sitemaps
ORACLE["ss3_sitemap_state_stream"] = SQ.ORACLE["p6_classify_sitemap_url"]


def _ss4(spark, sf):
    """Page summaries arriving as a stream, merged into the store."""
    pages = derived_from(spark, "audit_pages", pages=stream(spark, sf, "pages"))
    rows = pages.select(
        "url", F.concat(F.lit("S "), F.length("html")).alias("title"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(page_id % 20 AS INT)").alias("crawled_at"),
    )
    folder = shared_folder(spark, "kb")
    query = rows.writeStream.foreachBatch(J.upsert_kb_sink(f"{folder}/kb", F.expr(f"{LQ.NOW}"))).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    return J.read_current_kb(spark, f"{folder}/kb").select("domain", "url", "title", F.col("crawled_at").cast("string").alias("crawled_at"))


QUERIES["ss4_upsert_kb_stream"] = _ss4
ORACLE["ss4_upsert_kb_stream"] = f"""SELECT {LQ._KBD('url')} AS domain, url, 'S ' || length(html) AS title, CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST(page_id % 20 AS INT) AS VARCHAR) AS crawled_at FROM {LQ.AP}"""

QUERIES["ss5_latest_category_stream"] = lambda spark, sf: J.drain_updates(
    J.latest_category_stream(stream(spark, sf, "events", "progress_events")), "latest-category", ["session_id", "category"]
)
ORACLE["ss5_latest_category_stream"] = LQ.ORACLE["o8_latest_category_result"]
