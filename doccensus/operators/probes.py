"""Probe candidates, probe winners, link health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import first_per, round_half_up


def candidate_array(url: Column | str, filename: str, hints: Column | None = None) -> Column:
    """Candidates of a site file in the order they are tried: array of (source, url).

    Order: header hints, site root, documentation subpath, parent folders,
    ``.well-known``; a URL keeps its first position. Computed inside the row.
    """
    base, sub = U.base_url(url), U.docs_subpath(url)
    none = F.array().cast("array<struct<source:string,url:string>>")
    tag = lambda source, u: F.struct(F.lit(source).alias("source"), u.alias("url"))
    everything = F.concat(
        F.transform(hints, lambda h: tag("link-header", h)) if hints is not None else none,
        F.array(tag("direct-fetch", F.concat(base, F.lit("/" + filename)))),
        F.when(sub.isNotNull(), F.array(tag("subpath-probe", F.concat(base, sub, F.lit("/" + filename))))).otherwise(none),
        F.transform(U.walk_up(url, filename), lambda w: tag("walk-up-probe", w)),
        F.array(tag("well-known", F.concat(base, F.lit("/.well-known/" + filename)))),
    )
    urls = F.transform(everything, lambda x: x["url"])
    return F.filter(everything, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def probe_candidates(pages: DataFrame, filename: str, hints: Column | None = None) -> DataFrame:
    """One row per (page, candidate) with its priority."""
    rows = pages.select("page_id", F.posexplode(candidate_array("url", filename, hints)).alias("prio", "cand"))
    return rows.select("page_id", F.col("prio").cast("long").alias("prio"), F.col("cand.source").alias("source"), F.col("cand.url").alias("url"))


def probe_ok(log: DataFrame) -> DataFrame:
    """Add ``ok``: a 2xx answer that is not an HTML error page in disguise."""
    soft_404 = F.col("purpose").isin(list(K.EXPECTED_CONTENT_TYPES)) & F.coalesce(F.col("content_type"), F.lit("")).contains("text/html")
    return log.withColumn("ok", (F.col("status_code") >= 200) & (F.col("status_code") < 300) & ~soft_404)


def first_success(candidates: DataFrame, log: DataFrame, purpose: str) -> DataFrame:
    """Lowest-priority candidate that answered, one row per page that has one.

    The log is reduced to one row per good URL before the join.
    """
    good = probe_ok(log.filter(F.col("purpose") == purpose)).filter("ok").select("url").distinct()
    hits = candidates.join(good, ["url"])
    return first_per(hits, ["page_id"], [F.col("prio")], ["prio", "source", "url"])


def negotiated_markdown(log: DataFrame) -> DataFrame:
    return log.filter(
        (F.col("purpose") == "content-negotiation")
        & (F.col("status_code") >= 200) & (F.col("status_code") < 300)
        & F.col("content_type").contains("text/markdown")
    ).select("url").distinct()


def good_probes(log: DataFrame) -> DataFrame:
    """Distinct (url, purpose) pairs that count as found, each by its own rule."""
    negotiated = F.col("purpose") == "content-negotiation"
    found = F.col("ok") & (~negotiated | F.col("content_type").contains("text/markdown"))
    return probe_ok(log).filter(found).select("url", "purpose").distinct()


def answers_by_url(log: DataFrame) -> DataFrame:
    """One row per URL: ``found``, the purposes whose probes count as found (``good_probes``), and ``ok``, any 2xx answer."""
    rule = (F.col("purpose") != "content-negotiation") | F.coalesce(F.col("content_type").contains("text/markdown"), F.lit(False))
    good = F.when(F.col("ok") & rule, F.col("purpose"))
    answered = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return probe_ok(log).groupBy("url").agg(F.collect_set(good).alias("found"), F.coalesce(F.bool_or(answered), F.lit(False)).alias("ok"))


def latest_by_method(log: DataFrame) -> DataFrame:
    """Latest HEAD and GET result of every URL, side by side; one aggregate."""
    order = F.struct("ts", "event_id")
    result = F.struct("status_code", "failure")
    pick = lambda m: F.max_by(F.when(F.col("method") == m, result), F.when(F.col("method") == m, order)).alias(m.lower())
    return log.groupBy("domain", "url").agg(pick("HEAD"), pick("GET"))


def _denied(code: Column) -> Column:
    name = F.when(code == 401, "Unauthorized").otherwise("Forbidden")
    return F.concat(F.lit("refused ("), code, F.lit(" "), name, F.lit(")"))


def classify_link(log: DataFrame) -> DataFrame:
    """Link state from HEAD, with GET as the second opinion.

    A 404 on HEAD is final; any other failure is decided by GET.
    """
    both = latest_by_method(log).filter(F.col("head").isNotNull())
    head, get = F.col("head.status_code"), F.col("get.status_code")
    head_failed = F.col("head.failure").isNotNull() | (head == 0)
    get_timeout = F.col("get.failure") == "timeout"
    get_ok = (get > 0) & (get < 400)
    kind = (
        F.when(~head_failed & (head == 404), "404")
        .when(~head_failed & (head < 400), "healthy")
        .when(F.coalesce(get_ok, F.lit(False)), "healthy")
        .when(~head_failed & get.isin(401, 403), "access-denied")
        .when(head_failed & get_timeout, "timeout")
        .otherwise("error")
    )
    message = (
        F.when(F.col("link_state") == "404", "no page at this address")
        .when(F.col("link_state") == "access-denied", _denied(get))
        .when(F.col("link_state") == "timeout", "neither request was answered in time")
        .when((F.col("link_state") == "error") & (get > 0), F.concat(F.lit("HTTP "), get))
        .when(F.col("link_state") == "error", "failed for no known reason")
    )
    return both.withColumn("link_state", kind).select("domain", "url", "link_state", message.alias("message"))


def classify_sitemap_url(log: DataFrame) -> DataFrame:
    """State of sitemap URLs; only HEAD counts."""
    heads = latest_by_method(log).filter(F.col("head").isNotNull())
    code, failure = F.col("head.status_code"), F.col("head.failure")
    state = (
        F.when(failure == "timeout", "timeout")
        .when(failure.isNotNull() | (code == 0), "error")
        .when(code == 404, "404")
        .when(code.isin(401, 403), "access-denied")
        .when(code >= 400, "error")
        .otherwise("healthy")
    )
    return heads.select("domain", "url", state.alias("link_state"), code.cast("long").alias("status_code"))


def unique_links(links: DataFrame) -> DataFrame:
    """First anchor text of every (page, url)."""
    return first_per(links, ["page_id", "url"], [F.col("pos")], ["pos", "anchor_text"])


def health_summary(classified: DataFrame, key: str = "domain") -> DataFrame:
    """Counts by state and the healthy percentage, totals on distinct URLs.

    The percentage is 100 for a site without URLs.
    """
    n = lambda s: F.count_if(F.col("link_state") == s)
    total = F.count("*")
    return classified.groupBy(key).agg(
        total.alias("total"), n("healthy").alias("healthy"), n("404").alias("broken"), n("access-denied").alias("access_denied"),
        n("timeout").alias("timeouts"), n("error").alias("other_errors"),
        F.when(total == 0, F.lit(100)).otherwise(round_half_up(n("healthy") / total * 100)).cast("long").alias("health_pct"),
    )


def probe_stats(log: DataFrame, *keys: str, share: float = 0.95) -> DataFrame:
    """Probe volume, outcome mix and durations per purpose, or per further keys such as the page and purpose.

    ``slow_ms`` is the exact quantile of the durations, between two of them where it falls there.
    """
    code = F.col("status_code")
    return log.groupBy(*(keys or ("purpose",))).agg(
        F.count("*").alias("probes"), F.count_if((code >= 200) & (code < 300)).alias("ok_2xx"), F.count_if(code == 0).alias("failed"),
        F.count_if(code >= 400).alias("http_errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
        F.round(F.percentile("duration_ms", share), 4).alias("slow_ms"),
    )
