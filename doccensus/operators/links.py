"""Links of a page: extraction, classification, context pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import c, extract_all, salted_join, settled, top_k, trim_ws

HREF = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"
ANCHOR = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def hrefs(html: Column | str) -> Column:
    return extract_all(c(html), HREF)


def docs_url_filter(df: DataFrame, site: str, url: str, pattern: str = K.DOCS_URL_PATTERN) -> DataFrame:
    """Documentation URLs of every site; sites without any keep all pages.

    The per-site flag is a partial aggregate joined back, so a huge site is
    not gathered in one window partition.
    """
    is_doc = F.col(url).rlike("(?i)" + pattern)
    with_docs = df.filter(is_doc).select(site).distinct().withColumn("_has_docs", F.lit(True))
    plain = ~F.col(url).rlike("(?i)" + K.ASSET_URL_PATTERN) & ~F.col(url).contains("/tag/") & ~F.col(url).contains("/category/")
    return (
        salted_join(df, with_docs, [site], [url], "left")
        .filter(is_doc | (F.col("_has_docs").isNull() & plain))
        .drop("_has_docs")
    )


def page_links(pages: DataFrame, use_tld_list: bool = False) -> DataFrame:
    """One row per counted link: (page_id, pos, href, url, anchor_text, internal, other_page)."""
    anchors = F.arrays_zip(
        extract_all(F.col("html"), ANCHOR, 1).alias("href"), extract_all(F.col("html"), ANCHOR, 2).alias("inner")
    )
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(anchors).alias("pos", "a"))
    href = F.col("a.href")
    kept = rows.filter((href != "") & ~href.rlike("^(mailto:|tel:|javascript:|#)"))
    text = trim_ws(F.regexp_replace("a.inner", "<[^>]+>", ""))
    placed = kept.select(
        "page_id", "page_url", F.col("pos").cast("long").alias("pos"), href.alias("href"), text.alias("anchor_text"),
        U.resolve_url(href, "page_url").alias("url"),
    )
    link_host, page_host = U.host("url"), U.host("page_url")
    internal = (link_host != "") & U.is_related_domain(link_host, page_host, use_tld_list)
    return placed.select(
        "page_id", "pos", "href", "url", "anchor_text", internal.alias("internal"),
        (internal & (U.path("url") != U.path("page_url"))).alias("other_page"),
    )


def link_summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Link counts per page and the texts of up to ten sub pages.

    Pages are keyed by id, so groups are one page's links; texts are reduced to
    their first position per page before they are gathered.
    """
    counts = links.groupBy("page_id").agg(
        F.count("*").alias("total_links"), F.count_if("internal").alias("internal_links"), F.count_if(~F.col("internal")).alias("external_links")
    )
    texts = links.filter(F.col("other_page") & (F.col("anchor_text") != "")).groupBy("page_id", "anchor_text").agg(F.min("pos").alias("pos"))
    subs = texts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "anchor_text"))).alias("s")).select(
        "page_id", F.slice("s.anchor_text", 1, 10).alias("sub_pages")
    )
    zero = F.lit(0).cast("long")
    return (
        pages.select("page_id").join(counts, "page_id", "left").join(subs, "page_id", "left")
        .select(
            "page_id", *[F.coalesce(x, zero).alias(x) for x in ("total_links", "internal_links", "external_links")],
            F.coalesce("sub_pages", F.array().cast("array<string>")).alias("sub_pages"),
            F.when(F.size("sub_pages") > 0, "multi-page-referenced").otherwise("single-page").alias("link_context"),
        )
    )


def context_pages(pages: DataFrame, kb: DataFrame | None = None, children: int = 3, path_chars: int | None = 200) -> DataFrame:
    """Parent page and the first ``children`` child links of every page, parent first.

    A parent link in the navigation names the parent page; the last one wins. Links whose path has ``path_chars`` characters
    or more are not taken for child pages (None: any length); both limits are part of the result.
    """
    page_path = U.path("url")
    parts = U.segments(page_path)
    n = F.size(parts)
    parent_path = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n - 1), "/"), F.lit("/"))
    parent_url = F.concat(U.scheme("url"), F.lit("://"), U.host("url"), parent_path)
    nav = F.concat_ws("", extract_all(F.col("html"), r"(?is)<nav[^>]*>.*?</nav>", 0))
    crumbs = F.arrays_zip(extract_all(nav, ANCHOR, 1).alias("href"), extract_all(nav, ANCHOR, 2).alias("inner"))
    named = F.filter(crumbs, lambda a: a["href"].contains(parent_path))
    last_name = trim_ws(F.regexp_replace(F.get(F.reverse(named), F.lit(0))["inner"], "<[^>]+>", ""))
    parents = pages.filter(n > 1).select(
        "page_id", F.lit(0).cast("long").alias("ord"), parent_url.alias("url"),
        F.coalesce(F.nullif(last_name, F.lit("")), F.lit("Parent Documentation")).alias("title"),
        F.lit("parent").alias("relationship"), F.lit(0.8).alias("confidence"),
    )
    links = page_links(pages).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    p = U.path("url")
    child = (
        (F.col("anchor_text") != "") & (U.host("url") == U.host("page_url")) & p.startswith(U.path("page_url"))
        & (p != U.path("page_url"))
    )
    if path_chars is not None:
        child = child & (F.length(p) < path_chars)
    firsts = links.filter(child).groupBy("page_id", "url").agg(
        F.min("pos").alias("pos"), F.min_by("anchor_text", "pos").alias("title")
    )
    below = top_k(firsts, ["page_id"], [F.col("pos")], children, ["url"], rank="ord").select(
        "page_id", F.col("ord").cast("long").alias("ord"), "url", "title", F.lit("child").alias("relationship"), F.lit(0.7).alias("confidence")
    )
    both = parents.unionByName(below)
    firsts = both.groupBy("page_id", "url").agg(F.min_by(F.struct("ord", "title", "relationship", "confidence"), "ord").alias("r"))
    context = firsts.select("page_id", "r.ord", "url", "r.title", "r.relationship", "r.confidence")
    return context if kb is None else with_kb(context, kb)


def with_kb(context: DataFrame, kb: DataFrame) -> DataFrame:
    facts = kb.select("url", "documentation_type", "topic", "covers", "key_terms")
    return context.join(facts, ["url"], "left")


def add_selected_context(pages: DataFrame, context: DataFrame, kb: DataFrame, answers: DataFrame) -> DataFrame:
    """Add the store pages a reviewer picked, then mark what still needs fetching.

    ``answers`` holds (page_id, text) with a JSON list of positions in the
    page's catalog: the store entries of its domain that are neither the page
    nor already in its context, by url. Only picked positions are looked up:
    positions are shifted past the few excluded entries, so no page's catalog
    is ever built.
    """
    picks = answers.select(
        "page_id", F.posexplode(F.coalesce(F.from_json("text", "array<int>"), F.array().cast("array<int>"))).alias("ord", "idx")
    )
    # both are read several times, so they are worked out once
    context, ranked = settled(context), settled(kb_positions(kb))
    domain_size = ranked.groupBy("domain").agg(F.count("*").alias("entries"))
    keyed = pages.select("page_id", U.kb_domain("url").alias("domain"), F.col("url").alias("page_url"))
    known = context.select("page_id", "url").unionByName(keyed.select("page_id", F.col("page_url").alias("url"))).distinct()
    skipped = (
        known.join(keyed.select("page_id", "domain"), "page_id")
        .join(ranked.select("domain", "url", "kb_pos"), ["domain", "url"])
        .groupBy("page_id").agg(F.array_sort(F.collect_list("kb_pos")).alias("skip"))
    )
    asked = (
        picks.join(keyed, "page_id").join(domain_size, "domain").join(skipped, "page_id", "left")
        .withColumn("skip", F.coalesce("skip", F.array().cast("array<bigint>")))
    )
    # the i-th kept entry sits i places on, plus one for every skipped entry up to it
    shifted = F.aggregate("skip", F.col("idx").cast("long"), lambda at, s: F.when(s <= at, at + 1).otherwise(at))
    valid = asked.filter((F.col("idx") >= 0) & (F.col("idx") < F.col("entries") - F.size("skip"))).withColumn("kb_pos", shifted)
    first4 = top_k(valid, ["page_id"], [F.col("ord")], 4, ["ord"], rank="pick")
    siblings = first4.join(ranked, ["domain", "kb_pos"]).select(
        "page_id", (F.lit(3) + F.col("pick")).cast("long").alias("ord"), "url", F.coalesce("title", "url").alias("title"),
        F.lit("sibling").alias("relationship"), F.lit(0.6).alias("confidence"), "documentation_type", "topic", "covers", "key_terms",
    )
    everything = context.unionByName(siblings)
    open_rows = top_k(everything.filter(F.col("topic").isNull()), ["page_id"], [F.col("ord")], 3, ["url"], rank="_r")
    fetch = open_rows.select("page_id", "ord", F.lit(True).alias("to_fetch"))
    return everything.join(fetch, ["page_id", "ord"], "left").withColumn("to_fetch", F.coalesce("to_fetch", F.lit(False)))


def kb_positions(kb: DataFrame) -> DataFrame:
    """Store entries with their 0-based catalog position inside their domain.

    A catalog is ordered by the md5 of the url, so its leading digits cut even
    one huge domain into equal buckets; a position is the rank in the bucket
    plus the rows of the buckets before it.
    """
    placed = kb.withColumn("_h", F.md5("url")).withColumn("_b", F.substring("_h", 1, 3))
    sizes = placed.groupBy("domain", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("domain").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = sizes.select("domain", "_b", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("domain", "_b").orderBy("_h", "url")) - 1
    return (
        placed.join(offsets, ["domain", "_b"]).withColumn("kb_pos", (local + F.col("_before")).cast("long")).drop("_b", "_h", "_before")
    )


def context_scope(pages: DataFrame, context: DataFrame) -> DataFrame:
    """Scope, page total and number of enriched context pages per page."""
    counts = context.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("topic").isNotNull()).alias("enriched"))
    joined = pages.select("page_id").join(counts, "page_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select(
        "page_id", F.when(n > 0, "with-context").otherwise("single-page").alias("scope"), (n + 1).alias("total_pages"),
        F.coalesce("enriched", F.lit(0).cast("long")).alias("enriched"),
    )
