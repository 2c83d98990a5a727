"""Search queries for pages and how often answers cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import c, top_k, trim_ws

_TITLE_CUT = "[|\\-–—]"


def brand(title: Column | str, domain: Column | str) -> Column:
    """Last part of a separated title, else the first host label, capitalised."""
    parts = F.split(c(title), _TITLE_CUT)
    tail = F.when(F.size(parts) > 1, trim_ws(F.element_at(parts, -1)))
    label = F.substring_index(
        F.regexp_replace(c(domain), r"^(www|docs|developer|dev|cms|api|help|support|learn|blog)\.", ""), ".", 1
    )
    name = F.concat(F.upper(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return F.coalesce(F.nullif(tail, F.lit("")), name)


def template_queries(pages: DataFrame) -> DataFrame:
    """Up to five search queries per page: (page_id, pos, tier, query).

    ``pages`` carries (page_id, title, h1, description, domain). Brand names
    are literals, not patterns, when they are stripped.
    """
    parts = F.split("title", _TITLE_CUT)
    product = F.lower(F.when(F.size(parts) > 1, trim_ws(F.element_at(parts, -1))).otherwise(""))
    topic = F.lower(F.coalesce(F.nullif("h1", F.lit("")), trim_ws(F.get(parts, F.lit(0)))))
    site = F.lower(F.substring_index(F.regexp_replace("domain", r"^(www|dev|docs|api)\.", ""), ".", 1))
    words = F.filter(F.split(F.regexp_replace("description", "[.!?,;:]", ""), r"\s+"), lambda w: F.length(w) > 3)
    phrase = F.array_join(F.slice(words, 1, 5), " ")
    p = pages.select("page_id", product.alias("product"), topic.alias("topic"), site.alias("site"), phrase.alias("phrase"))

    def branded(text: Column) -> Column:
        low = F.lower(text)
        return ((F.col("product") != "") & low.contains(F.col("product"))) | ((F.length("site") > 2) & low.contains(F.col("site")))

    drop = lambda text, word: F.when(word == "", text).otherwise(F.replace(text, word, F.lit("")))
    bare = trim_ws(F.regexp_replace(drop(drop(F.col("topic"), F.col("site")), F.col("product")), r"\s+", " "))
    p = p.withColumn("clean", F.when(branded(F.col("topic")), bare).otherwise(F.col("topic"))).withColumn("is_branded", branded(F.col("topic")))
    long = F.length("clean") > 5
    row = lambda tier, cond, text: F.when(cond, F.struct(F.lit(tier).alias("tier"), text.alias("query")))
    rows = F.array(
        row("high", (F.col("topic") != "") & (~F.col("is_branded") | long), F.col("clean")),
        row("mid", long, F.concat(F.lit("how to "), "clean")),
        row("mid", (F.length("phrase") > 5) & ~branded(F.col("phrase")), F.col("phrase")),
        row("low", long, F.concat("clean", F.lit(" best practices"))),
        row("low", long, F.concat("clean", F.lit(" not working"))),
    )
    made = p.select("page_id", F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("pos", "q"))
    return made.select("page_id", F.col("pos").cast("long").alias("pos"), "q.tier", "q.query")


def cited(citations: DataFrame) -> DataFrame:
    """Whether each query cited its page, and the first citation that did.

    ``citations`` holds (page_id, target_url, tier, query_pos, pos, cited_url),
    with a null ``cited_url`` for a query that cited nothing. The domain test
    is a substring test.
    """
    named = citations.withColumn("_host", U.host("target_url")).withColumn("_root", U.registrable_domain("_host"))
    named = named.withColumn("_docs", U.is_docs_subdomain("_host")).withColumn("_own", U.host_path_key("target_url"))
    link = F.col("cited_url")
    hit = F.coalesce(
        link.contains(F.col("_host")) | (F.col("_docs") & link.contains(F.col("_root"))) | (U.host_path_key(link) == F.col("_own")), F.lit(False)
    )
    citations = named.withColumn("_hit", hit)
    hit = F.col("_hit")
    return citations.groupBy("page_id", "query_pos", "tier").agg(
        F.bool_or(hit).alias("cited"), F.min_by("cited_url", F.when(hit, F.col("pos"))).alias("first_cited"),
        F.count("cited_url").alias("total_citations"),
    )


def competing_domains(citations: DataFrame, limit: int = 3) -> DataFrame:
    """First other sites cited by queries that missed the page."""
    answered = cited(citations).filter(~F.col("cited")).select("page_id", "query_pos")
    rows = citations.join(answered, ["page_id", "query_pos"]).filter(F.col("cited_url").isNotNull())
    own = F.regexp_replace(U.host("target_url"), r"^www\.", "")
    named = rows.withColumn("domain", F.regexp_replace(U.host("cited_url"), r"^www\.", "")).withColumn("own", own)
    root_hit = U.is_docs_subdomain("own") & F.col("domain").contains(U.registrable_domain("own"))
    kept = named.filter(
        (F.col("domain") != "") & ~F.col("domain").contains(F.col("own")) & ~root_hit & ~F.col("domain").isin(K.SKIPPED_PLATFORMS)
    )
    firsts = kept.groupBy("page_id", "query_pos", "domain").agg(F.min("pos").alias("pos"))
    ranked = top_k(firsts, ["page_id", "query_pos"], [F.col("pos"), F.col("domain")], limit, ["domain"])
    return ranked.groupBy("page_id", "query_pos").agg(F.array_sort(F.collect_list(F.struct("rank", "domain"))).alias("d")).select(
        "page_id", "query_pos", F.col("d.domain").alias("competitors")
    )


def found_rates(results: DataFrame) -> DataFrame:
    """Share of cited queries per page, by tier, and the tier of the page."""
    rate = F.avg(F.col("cited").cast("double"))
    by_tier = lambda t: F.avg(F.when(F.col("tier") == t, F.col("cited").cast("double")))
    return results.groupBy("page_id").agg(
        rate.alias("found_rate"), *[by_tier(t).alias(f"{t}_rate") for t in ("high", "mid", "low")]
    ).withColumn("citation_tier", citation_tier(F.col("found_rate")))


def citation_tier(rate: Column) -> Column:
    return F.when(rate >= 0.6, "high").when(rate >= 0.3, "partial").when(rate > 0, "low").otherwise("not-found")
