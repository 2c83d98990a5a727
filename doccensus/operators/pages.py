"""The page-feature job: every audit column of a page in two projections.

Only the markdown columns look outside the page; they join the fetch log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.functions import html as H
from doccensus.functions import urls as U
from doccensus.functions.common import salted_join, settled
from doccensus.operators.probes import answers_by_url
from doccensus.operators.robots import bot_status_v1, sitemap_directive


def page_features(pages: DataFrame, **more: Column) -> DataFrame:
    """One row per page, no shuffle; ``more`` columns are worked out in the same pass.

    The first projection strips markup once per text profile; the second reads
    those columns, so no long pattern chain runs twice.
    """
    stripped = pages.select(
        "page_id", "url", "html",
        U.host("url").alias("host"),
        U.base_url("url").alias("base_url"),
        H.visible_text("html", "ratio").alias("_ratio"),
        H.visible_text("html", "words").alias("_words"),
        H.content_html("html").alias("_content"),
        H.headings("html").alias("_heads"),
        H.og_tags("html").alias("_og"),
        H.jsonld_blocks("html").alias("_ld"),
        H.code_block_count("html").alias("code_blocks"),
        H.language_hint_count("html").alias("code_hints"),
        *[col.alias(name) for name, col in more.items()],
    )
    parsed = (
        stripped.withColumn("_types", H.jsonld_types(F.col("_ld")))
        .withColumn("_fields", H.jsonld_fields(F.col("_ld")))
        .withColumn("internal_links", H.internal_link_count(F.col("_content"), F.col("host")))
        .withColumn("_kwords", H.density_kwords(F.col("_content")))
        .withColumn("_missing", H.missing_fields(F.col("_types"), F.col("_fields")))
    )
    ratio = F.octet_length("_ratio") / F.octet_length("html")
    levels = F.col("_heads.level")
    return parsed.select(
        "page_id", "url", "host", "base_url",
        H.title("html").alias("title"),
        F.when(F.octet_length("html") == 0, F.lit(0.0)).otherwise(ratio).alias("ratio"),
        F.when(F.octet_length("html") == 0, "very-low").otherwise(H.ratio_status(ratio)).alias("ratio_status"),
        H.js_rendered("html", F.col("_ratio")).alias("js_rendered"),
        H.word_count(F.col("_words")).alias("words"),
        *[H.heading_count(levels, i).alias(f"h{i}_count") for i in (1, 2, 3)],
        F.least(F.size("_heads"), F.lit(20)).cast("long").alias("heading_count"),
        H.proper_nesting(levels).alias("proper_nesting"),
        "code_blocks", "code_hints", (F.col("code_blocks") > 0).alias("has_code"),
        "internal_links",
        H.density_status(F.col("internal_links"), F.col("internal_links") / F.col("_kwords")).alias("density_status"),
        H.page_type("html", "url").alias("page_type"),
        H.canonical_url("html", forward_only=True).isNotNull().alias("has_canonical"),
        H.blocks_indexing("html").alias("blocks_indexing"),
        (F.size("_ld") > 0).alias("has_jsonld"),
        F.col("_types").alias("schema_types"),
        H.valid_schema(F.col("_types")).alias("valid_schema"),
        H.schema_status(F.col("_types"), F.col("_missing")).alias("schema_status"),
        F.col("_missing").alias("missing_fields"),
        H.og_completeness(F.col("_og")).alias("og_status"),
        H.missing_og(F.col("_og")).alias("missing_og"),
        H.has_breadcrumbs("html").alias("has_breadcrumbs"),
        *more,
    )


def _answered(log: DataFrame, name: str) -> DataFrame:
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300)
    return log.filter(ok).select(F.col("url").alias(name)).distinct()


def markdown_availability(pages: DataFrame, log: DataFrame, llms_found: DataFrame | None = None) -> DataFrame:
    """Whether a markdown version exists and how a reader would learn of it.

    ``pages`` carries (page_id, url, html, headers). With ``llms_found``
    (page_id, llms_found), a site file also makes it discoverable; without it
    that route is closed.
    """
    found = pages.select("page_id", *[col.alias(name) for name, col in _markdown_facts().items()])
    probed = found.join(_answered(log, "probe").withColumn("probe_ok", F.lit(True)), "probe", "left")
    if llms_found is not None:
        probed = probed.join(llms_found, "page_id", "left")
    by_llms = F.coalesce(F.col("llms_found"), F.lit(False)) if llms_found is not None else F.lit(False)
    return probed.select("page_id", *_markdown_columns(F.col("probe_ok").isNotNull(), by_llms))


def _markdown_facts() -> dict[str, Column]:
    """What the page and its headers say about a markdown version, and the address to probe."""
    base = U.base_url("url")
    alternate = H.md_alternate("html")
    link = H.header(F.col("headers"), "link")
    from_header = F.when(link.contains("text/markdown"), H.extract(link, r"(?i)<([^>]+)>;\s*rel=\"alternate\";\s*type=\"text/markdown\""))
    none = F.array().cast("array<string>")
    known = F.concat(
        F.when(alternate.isNotNull(), F.array(H.site_join(base, alternate))).otherwise(none),
        F.when(from_header.isNotNull(), F.array(from_header)).otherwise(none),
        H.md_link_urls("html", base),
    )
    named = F.when(from_header.isNotNull(), "link-header").when(alternate.isNotNull(), "link-alternate")
    return {"known": known, "probe": F.concat(F.regexp_replace("url", "/$", ""), F.lit(".md")), "named": named}


def _markdown_columns(probe_ok: Column, by_llms: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    urls = F.when(F.size("known") > 0, F.col("known")).when(probe_ok, F.array("probe")).otherwise(none)
    method = F.coalesce("named", F.when(by_llms, F.lit("llms-txt")), F.lit("none"))
    return [
        (F.size(urls) > 0).alias("markdown_found"), F.array_distinct(urls).alias("markdown_urls"),
        (F.col("named").isNotNull() | by_llms).alias("markdown_discoverable"), F.when(F.size(urls) > 0, method).alias("markdown_method"),
    ]


def _site_file_probes() -> Column:
    """The site files looked for: array of (kind, asked)."""
    base, sub = U.base_url("url"), U.docs_subpath("url", 2)
    ask = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("asked"))
    return F.array(
        ask("llms", F.concat(base, F.lit("/llms.txt"))), ask("llms", F.concat(base, sub, F.lit("/llms.txt"))),
        ask("full", F.concat(base, F.lit("/llms-full.txt"))), ask("full", F.concat(base, sub, F.lit("/llms-full.txt"))),
        ask("map", F.concat(base, F.lit("/sitemap.xml"))),
    )


def site_file_flags(pages: DataFrame, log: DataFrame, robots: DataFrame) -> DataFrame:
    """llms.txt, llms-full.txt and sitemap presence per page."""
    asked = pages.select("page_id", U.base_url("url").alias("base_url"), F.explode(_site_file_probes()).alias("a")).select("page_id", "base_url", "a.kind", "a.asked")
    named = robots.select("base_url", sitemap_directive("body").alias("directive"))
    asked = salted_join(asked, named, ["base_url"], ["page_id"], "left").withColumn(
        "asked", F.when(F.col("kind") == "map", F.coalesce("directive", "asked")).otherwise(F.col("asked"))
    )
    hits = asked.join(_answered(log, "asked").withColumn("hit", F.lit(True)), ["asked"], "left")
    has = lambda k: F.coalesce(F.bool_or((F.col("kind") == k) & F.col("hit").isNotNull()), F.lit(False))
    return hits.groupBy("page_id").agg(
        has("llms").alias("llms_found"), has("full").alias("llms_full_found"), has("map").alias("sitemap_found")
    )


def readiness_features(
    pages: DataFrame, log: DataFrame, robots: DataFrame, reference_mode: bool = False, answers: DataFrame | None = None
) -> DataFrame:
    """Page features, markdown availability, site files and bot counts in one row.

    Markup is read in one pass that writes a narrow row per page, with its site's facts and all that is to be probed; one join
    of these probes with the answers by URL and one aggregate per page decide everything else. ``answers``
    (``probes.answers_by_url``) is given where several reports share it. ``reference_mode`` closes the llms.txt route
    to markdown discovery.
    """
    answers = answers_by_url(log) if answers is None else answers
    bots = bot_status_v1(robots.select(F.col("base_url").alias("domain"), "body")).groupBy(F.col("domain").alias("base_url")).agg(
        F.count_if(F.col("status") == "blocked").alias("bots_blocked"), F.count_if(F.col("status") == "not-mentioned").alias("bots_unlisted")
    )
    site = robots.select("base_url", (F.coalesce("body", F.lit("")) != "").alias("has_robots"), sitemap_directive("body").alias("directive"))
    facts = settled(
        salted_join(page_features(pages, **_markdown_facts(), asked=_site_file_probes()), site.join(bots, "base_url", "left"), ["base_url"], ["page_id"], "left")
    )
    named = F.transform("asked", lambda a: F.struct(a["kind"].alias("kind"), F.when(a["kind"] == "map", F.coalesce("directive", a["asked"])).otherwise(a["asked"]).alias("url")))
    probes = F.concat(named, F.array(F.struct(F.lit("md").alias("kind"), F.col("probe").alias("url"))))
    hits = facts.select("page_id", F.explode(probes).alias("a")).select("page_id", "a.*").join(answers.filter("ok").select("url"), "url")
    found = hits.groupBy("page_id").agg(F.collect_set("kind").alias("kinds"))
    has = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    by_llms = F.lit(False) if reference_mode else has("llms")
    probed = facts.join(found, "page_id", "left")
    inner = ("known", "probe", "named", "asked", "directive", "kinds")
    return probed.select(
        *[x for x in probed.columns if x not in (*inner, "has_robots")], F.coalesce("has_robots", F.lit(False)).alias("has_robots"),
        has("llms").alias("llms_found"), has("full").alias("llms_full_found"), has("map").alias("sitemap_found"), *_markdown_columns(has("md"), by_llms),
    )


NOISE_TAGS = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe"]


def noise_reduction(html: Column | str, tags: list[str] | None = None) -> dict[str, Column]:
    """Size before and after noise blocks are dropped, and the share of it in percent."""
    h = F.col(html) if isinstance(html, str) else html
    before, after = F.length(h), F.length(H.drop_blocks(h, NOISE_TAGS if tags is None else tags))
    return {
        "original_size": before.cast("long"), "cleaned_size": after.cast("long"), "reduction_pct": F.floor((1 - after / before) * 100 + 0.5),
    }


def chunking_flags(words: Column, h2: Column) -> dict[str, Column]:
    """What the length of a page and its second-level headings say about how well it can be cut."""
    average = F.when(h2 > 0, F.floor(words / h2 + 0.5)).otherwise(words)
    unchunked = (words > 1500) & (h2 < 3)
    return {
        "unchunked": unchunked, "long_sections": ~unchunked & (h2 > 0) & (average > 500), "very_short": (words > 0) & (words < 100),
        "short": (words >= 100) & (words < 500), "thin_sections": (h2 > 8) & (words < 600),
    }


def page_type_review(confidence: Column, rejected: Column, low: float = 0.4, high: float = 0.95, cap: float = 0.3) -> dict[str, Column]:
    """Pages of middling confidence need a second opinion; a rejection caps them at ``cap``."""
    ambiguous = (confidence >= low) & (confidence < high)
    return {
        "is_doc": confidence >= low, "needs_review": ambiguous,
        "reviewed_confidence": F.when(ambiguous & rejected, F.least(confidence, F.lit(cap))).otherwise(confidence),
    }
