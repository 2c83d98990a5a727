"""Scores, grades, recommendations and report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import round_half_up


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for cond, n in rules:
        total = total + F.when(cond, n).otherwise(0)
    return total


def readiness_scores(f: DataFrame) -> DataFrame:
    """Discoverability (40), consumability (40) and structured data (20).

    Discoverability has no floor: a page that only blocks indexing scores -5.
    """
    c = F.col
    discover = _points(
        (c("llms_found"), 15), (c("sitemap_found"), 8), (c("has_canonical"), 5), (c("blocks_indexing"), -5),
        (c("markdown_found") & c("markdown_discoverable"), 12), (c("markdown_found") & ~c("markdown_discoverable"), 8),
    )
    ideal = c("words").between(500, 2000)
    consume = _points(
        (c("h1_count") == 1, 12), (c("h1_count") > 1, 4), (c("proper_nesting"), 8), (~c("js_rendered"), 10),
        (ideal, 6), (~ideal & (c("words") >= 300), 3), (c("density_status") == "good", 4),
    )
    data = _points(
        (c("has_jsonld") & c("valid_schema"), 5), (c("has_jsonld") & ~c("valid_schema"), 3),
        (c("schema_status") == "complete", 2), (c("schema_status") == "partial", 1),
        (c("og_status") == "complete", 10), (c("og_status") == "partial", 6), (c("has_breadcrumbs"), 3),
    )
    cap = lambda s, top: F.least(s, F.lit(top)).cast("long")
    scored = f.withColumn("discoverability", cap(discover, 40)).withColumn("consumability", cap(consume, 40)).withColumn("structured", cap(data, 20))
    return scored.withColumn("overall", F.col("discoverability") + F.col("consumability") + F.col("structured"))


def grade(score: Column) -> Column:
    out = None
    for name, least in K.GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def citation_score(found_rate: Column) -> Column:
    return round_half_up(found_rate * K.CITATION_WEIGHT)


def recommendation_rules(f: DataFrame) -> DataFrame:
    """Every rule that fires, one row each: (page_id, ord, rule, category, priority, args, has_snippet).

    ``args`` are the values a message needs; wording is applied when printing.
    """
    c = F.col
    text = lambda col: col.cast("string")
    md = c("markdown_found")
    avg = F.when(c("h2_count") > 0, F.floor(c("words") / c("h2_count") + 0.5)).otherwise(c("words"))
    pct = F.format_number(c("ratio") * 100, 1)
    unchunked = (c("words") > 1500) & (c("h2_count") < 3)
    typed = F.size("schema_types") > 0
    rules = [
        ("robots-missing", "Bot Access", F.lit("medium"), ~c("has_robots"), None, True),
        ("bots-blocked", "Bot Access", F.lit("high"), c("has_robots") & (c("bots_blocked") > 0), text(c("bots_blocked")), True),
        ("bots-unlisted", "Bot Access", F.lit("low"), c("has_robots") & (c("bots_unlisted") > 0) & (c("bots_unlisted") < 10), text(c("bots_unlisted")), True),
        ("llms-missing", "Discoverability", F.lit("high"), ~c("llms_found"), None, True),
        ("sitemap-missing", "Discoverability", F.lit("medium"), ~c("sitemap_found"), None, True),
        ("canonical-missing", "Discoverability", F.lit("low"), ~c("has_canonical"), None, True),
        ("noindex", "Discoverability", F.lit("high"), c("blocks_indexing"), None, False),
        ("js-rendered", "Consumability", F.lit("high"), c("js_rendered"), None, False),
        ("h1-missing", "Consumability", F.lit("medium"), c("h1_count") == 0, None, False),
        ("h1-repeated", "Consumability", F.lit("low"), c("h1_count") > 1, text(c("h1_count")), False),
        ("heading-skips", "Consumability", F.lit("low"), ~c("proper_nesting") & (c("heading_count") > 2), None, False),
        ("markdown-missing", "Consumability", F.lit("medium"), ~md, None, True),
        ("markdown-hidden", "Discoverability", F.lit("best-practice"), md & ~c("markdown_discoverable"), None, True),
        ("ratio-very-low", "Consumability", F.when(md, "low").otherwise("high"), c("ratio_status") == "very-low", pct, False),
        ("ratio-low", "Consumability", F.lit("medium"), (c("ratio_status") == "low") & ~md, pct, False),
        ("code-unlabelled", "Consumability", F.when(md, "low").otherwise("medium"), c("has_code") & (c("code_hints") == 0), text(c("code_blocks")), True),
        ("few-links", "Consumability", F.lit("low"), (c("density_status") == "sparse") & (c("internal_links") < 3), None, False),
        ("unchunked", "Consumability", F.lit("high"), unchunked, F.concat_ws("/", F.format_number("words", 0), "h2_count"), False),
        ("long-sections", "Consumability", F.lit("medium"), ~unchunked & (c("h2_count") > 0) & (avg > 500), text(avg), False),
        ("very-short", "Consumability", F.lit("medium"), (c("words") > 0) & (c("words") < 100), text(c("words")), False),
        ("short", "Consumability", F.lit("low"), (c("words") >= 100) & (c("words") < 500), text(c("words")), False),
        ("thin-sections", "Consumability", F.lit("low"), (c("h2_count") > 8) & (c("words") < 600), F.concat_ws("/", "h2_count", "words"), False),
        ("api-without-code", "Consumability", F.lit("high"), (c("page_type") == "api-reference") & ~c("has_code"), None, False),
        ("jsonld-missing", "Structured Data", F.lit("low"), ~typed, None, True),
        ("jsonld-generic", "Structured Data", F.lit("low"), typed & ~c("valid_schema"), F.array_join("schema_types", ", "), False),
        ("schema-partial", "Structured Data", F.lit("low"), c("schema_status") == "partial", F.array_join("missing_fields", ", "), False),
        ("og-partial", "Structured Data", F.lit("low"), c("og_status") == "partial", F.array_join("missing_og", ", "), True),
        ("og-missing", "Structured Data", F.lit("medium"), c("og_status") == "missing", None, True),
        ("breadcrumbs-missing", "Structured Data", F.lit("low"), ~c("has_breadcrumbs"), None, True),
    ]
    made = F.array(*[
        F.when(cond, F.struct(
            F.lit(i).cast("long").alias("ord"), F.lit(rule).alias("rule"), F.lit(cat).alias("category"), prio.alias("priority"),
            (F.lit(None).cast("string") if args is None else args).alias("args"), F.lit(snippet).alias("has_snippet"),
        ))
        for i, (rule, cat, prio, cond, args, snippet) in enumerate(rules)
    ])
    return f.select("page_id", F.explode(F.filter(made, lambda r: r.isNotNull())).alias("r")).select("page_id", "r.*")


# what to tell a reader about each rule; {0} is the rule's args
RULE_TEXTS = {
    "robots-missing": ("There is no robots.txt, so crawlers fall back to their defaults.", "Publish a robots.txt with a rule for each AI crawler."),
    "bots-blocked": ("{0} AI crawlers are turned away.", "Allow them in robots.txt if answers should quote this site."),
    "bots-unlisted": ("{0} AI crawlers have no rule of their own.", "State an explicit rule for each."),
    "llms-missing": ("No llms.txt was found.", "List the documentation pages in an llms.txt at the site root."),
    "sitemap-missing": ("No sitemap was found.", "Publish sitemap.xml and name it in robots.txt."),
    "canonical-missing": ("The page names no canonical URL.", "Add a canonical link to the head."),
    "noindex": ("The page asks not to be indexed.", "Drop noindex if the page should be found."),
    "js-rendered": ("The page is empty without JavaScript.", "Render the content on the server."),
    "h1-missing": ("There is no H1.", "Add one that names the topic."),
    "h1-repeated": ("There are {0} H1 headings.", "Keep one H1 and use H2 below it."),
    "heading-skips": ("Heading levels are skipped.", "Step one level at a time."),
    "markdown-missing": ("No markdown version was found.", "Serve one and link it as an alternate."),
    "markdown-hidden": ("The markdown version is not announced.", "Link it from the head as an alternate."),
    "ratio-very-low": ("Only {0}% of the page is text.", "Move scripts and styles out of the page."),
    "ratio-low": ("Just {0}% of the page is text.", "Trim scripts, styles and navigation."),
    "code-unlabelled": ("None of {0} code blocks names its language.", "Add a language class."),
    "few-links": ("Hardly any internal links.", "Link related pages."),
    "unchunked": ("Too few H2 headings for the text (words/headings {0}).", "Split the page or add H2 headings."),
    "long-sections": ("Sections average {0} words.", "Add subheadings."),
    "very-short": ("Only {0} words.", "Explain more."),
    "short": ("A short page of {0} words.", "Add examples and edge cases."),
    "thin-sections": ("Many headings, few words ({0}).", "Merge or extend sections."),
    "api-without-code": ("An API page without code.", "Add request and response examples."),
    "jsonld-missing": ("No JSON-LD.", "Describe the page with a schema.org type."),
    "jsonld-generic": ("JSON-LD of type {0} says little about documentation.", "Use TechArticle, HowTo, FAQPage or APIReference."),
    "schema-partial": ("JSON-LD lacks {0}.", "Fill in the missing fields."),
    "og-partial": ("OpenGraph lacks {0}.", "Add the missing tags."),
    "og-missing": ("No OpenGraph tags.", "Add title, description, image and type."),
    "breadcrumbs-missing": ("No breadcrumb markup.", "Add a BreadcrumbList."),
    "citations-not-found": ("No answer engine cited the page.", "Add llms.txt and structured data and keep the page indexable."),
    "citations-low": ("Answer engines rarely cite the page.", "Allow their crawlers and submit the sitemap."),
    "citations-partial": ("Answer engines cite the page for some queries.", "Make the content and headings more specific."),
    "link-header-mismatch": ("{0}", "Point the Link header at the file that exists."),
    "llms-advertised": ("{0}", "Create the advertised llms.txt or drop the header."),
    "llms-full-advertised": ("{0}", "Make the referenced llms-full.txt reachable."),
    "markdown-advertised": ("{0}", "Make the advertised markdown version reachable."),
    "agents-file": ("{0}", "Keep the file maintained; it is not scored."),
    "mcp-config": ("{0}", "Keep the file maintained; it is not scored."),
    "llms-full-note": ("{0}", "Point the Link header at the right llms-full.txt."),
}


def rule_text(rule: Column, args: Column, part: int) -> Column:
    """Message (part 0) or fix (part 1) of a rule, arguments filled in."""
    pairs = [F.lit(x) for k, v in RULE_TEXTS.items() for x in (k, v[part])]
    return F.replace(F.try_element_at(F.create_map(*pairs), rule), F.lit("{0}"), F.coalesce(args, F.lit("")))


def citation_recommendations(rates: DataFrame) -> DataFrame:
    """Advice from the citation tier; well-cited pages get none."""
    prio = F.when(F.col("citation_tier").isin("not-found", "low"), "high").when(F.col("citation_tier") == "partial", "medium")
    return rates.filter(prio.isNotNull()).select(
        "page_id", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("citations-"), F.col("citation_tier")).alias("rule"),
        F.lit("AI Discoverability").alias("category"), prio.alias("priority"), F.lit(None).cast("string").alias("args"), F.lit(False).alias("has_snippet"),
    )


def detection_notes(signals: DataFrame, reference_mode: bool = False) -> DataFrame:
    """Best-practice notes from evidence signals, in a fixed order.

    Experimental files are praised only when they exist, unless
    ``reference_mode`` asks for the older habit of always doing so.
    """
    s, st, note, url = F.col("signal"), F.col("status"), F.col("note"), F.col("validated_url")
    present = url.isNotNull() | F.lit(reference_mode)
    rule = (
        F.when((s == "llms.txt") & (st == "verified") & note.isNotNull(), F.struct(F.lit(0).alias("ord"), F.lit("link-header-mismatch").alias("rule")))
        .when((s == "llms.txt") & (st == "advertised"), F.struct(F.lit(1).alias("ord"), F.lit("llms-advertised").alias("rule")))
        .when((s == "llms-full.txt") & (st == "advertised") & note.isNotNull(), F.struct(F.lit(2).alias("ord"), F.lit("llms-full-advertised").alias("rule")))
        .when((s == "markdown") & (st == "advertised") & note.isNotNull(), F.struct(F.lit(3).alias("ord"), F.lit("markdown-advertised").alias("rule")))
        .when((s == "AGENTS.md") & (st == "experimental") & present, F.struct(F.lit(4).alias("ord"), F.lit("agents-file").alias("rule")))
        .when((s == "mcp.json") & (st == "experimental") & present, F.struct(F.lit(5).alias("ord"), F.lit("mcp-config").alias("rule")))
        .when((s == "llms-full.txt") & (st == "verified") & note.isNotNull(), F.struct(F.lit(6).alias("ord"), F.lit("llms-full-note").alias("rule")))
    )
    return signals.withColumn("_r", rule).filter(F.col("_r").isNotNull()).select(
        "page_id", F.col("_r.ord").cast("long").alias("ord"), F.col("_r.rule").alias("rule"), F.lit("Discoverability").alias("category"),
        F.lit("best-practice").alias("priority"), note.alias("args"), F.lit(False).alias("has_snippet"),
    )


def priority_rank(priority: Column) -> Column:
    out = None
    for name, r in K.PRIORITY_ORDER.items():
        out = F.when(priority == name, r) if out is None else out.when(priority == name, r)
    return out.otherwise(3)


def merge_recommendations(readiness: DataFrame, citations: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One ordered list per page: by priority, then source, then rule order; notes last.

    A page has at most a few dozen rules, so ranking inside a page is bounded.
    """
    tag = lambda df, i: df.withColumn("_source", F.lit(i))
    all_rows = tag(readiness, 0).unionByName(tag(citations, 1))
    if notes is not None:
        all_rows = all_rows.unionByName(tag(notes, 2))
    rank = F.when(F.col("_source") == 2, 9).otherwise(priority_rank(F.col("priority")))
    w = Window.partitionBy("page_id").orderBy(rank, "_source", "ord")
    return all_rows.withColumn("position", F.row_number().over(w).cast("long")).drop("_source", "ord")


def recommendation_buckets(recs: DataFrame) -> DataFrame:
    """Bucket, impact, effort and whether a row is among the page's top three."""
    scored = F.col("priority") != "best-practice"
    bucket = F.when(F.col("priority") == "high", "Quick Wins").when(scored, "Deeper Improvements").otherwise("Things to Watch")
    w = Window.partitionBy("page_id").orderBy(F.when(scored, 0).otherwise(1), F.when(F.col("priority") == "high", 0).otherwise(1), "position")
    return recs.withColumn("bucket", bucket).withColumn("_n", F.row_number().over(w)).select(
        "page_id", "position", "rule", "bucket", (scored & (F.col("_n") <= 3)).alias("is_top"),
        F.when(F.col("priority") == "high", "High impact").when(F.col("priority") == "medium", "Medium impact").otherwise("Low impact").alias("impact"),
        F.when(F.col("has_snippet"), "Medium effort").otherwise("Low effort").alias("effort"),
    )


def health_counter(f: DataFrame) -> DataFrame:
    c = F.col
    checks = [
        c("llms_found"), c("llms_full_found"), c("sitemap_found"), c("has_canonical"), ~c("blocks_indexing"),
        c("ratio_status") == "good", ~c("js_rendered"), c("h1_count") == 1, c("markdown_found"), ~c("has_code") | (c("code_hints") > 0), c("density_status") == "good",
        c("has_jsonld"), c("schema_status") != "missing", c("og_status") != "missing", c("has_breadcrumbs"),
    ]
    passed = sum((x.cast("int") for x in checks), F.lit(0))
    return f.select("page_id", passed.cast("long").alias("passed"), F.lit(len(checks)).cast("long").alias("total"))


def grade_label(score: Column, n: Column) -> Column:
    return F.when(n == 0, "clean").otherwise(
        F.concat(
            F.when(score >= 90, "very good").when(score >= 75, "good").when(score >= 60, "middling").otherwise("poor"),
            F.lit(", open points: "), n.cast("string"),
        )
    )


# ── dimension scores ────────────────────────────────────────────────────


def dimension_weight(content_type: Column, dimension: Column) -> Column:
    """Weight from the fixed 10 × 5 table, as a literal map lookup."""
    pairs = [
        F.lit(x) for t, ws in K.CONTENT_TYPE_WEIGHTS.items() for d, w in zip(K.DIMENSIONS, ws) for x in (f"{t}|{d}", float(w))
    ]
    known = F.when(content_type.isin(list(K.CONTENT_TYPE_WEIGHTS)), content_type).otherwise("mixed")
    return F.try_element_at(F.create_map(*pairs), F.concat(known, F.lit("|"), dimension))


def apply_weights(dims: DataFrame) -> DataFrame:
    weight = dimension_weight(F.col("content_type"), F.col("dimension"))
    return dims.withColumn("weight", F.when(F.col("score").isNotNull(), weight))


def slug_penalty(high: Column, medium: Column) -> Column:
    return F.least(F.lit(25), high * 5 + medium * 3)


def penalise_clarity(dims: DataFrame, penalties: DataFrame) -> DataFrame:
    """Lower clarity by its page's slug penalty, not below 0."""
    joined = dims.join(penalties.select("page", "penalty"), "page", "left")
    lowered = F.when(F.col("score").isNotNull(), F.greatest(F.lit(0.0), F.col("score") - F.coalesce("penalty", F.lit(0))))
    return joined.withColumn("score", F.when(F.col("dimension") == "clarity", lowered).otherwise(F.col("score"))).drop("penalty")


def weighted_overall(dims: DataFrame) -> DataFrame:
    """Weighted mean of the scores a page has; null when it has none.

    A page has five dimensions; they are added in their fixed order so that a
    sum close to a half always rounds the same way.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in K.DIMENSIONS]), F.col("dimension"))
    row = F.when(F.col("score").isNotNull(), F.struct(order.alias("d"), "score", F.coalesce("weight", F.lit(0.20)).alias("w")))
    add = lambda of: F.aggregate("rows", F.lit(0.0), lambda a, r: a + of(r))
    rows = dims.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    mean = F.when(F.size("rows") > 0, add(lambda r: r["score"] * r["w"]) / add(lambda r: r["w"]))
    return rows.select("page", round_half_up(mean).alias("overall"))


def simple_overall(dims: DataFrame) -> DataFrame:
    ok = F.when((F.col("status") == "complete"), F.col("score"))
    n = F.count(ok)
    return dims.groupBy("page").agg(
        F.coalesce(round_half_up(F.avg(ok)), F.lit(0)).cast("long").alias("overall"), n.alias("dimensions_analyzed"),
        F.when(n == 5, "high").when(n >= 3, "medium").otherwise("low").alias("confidence"),
    )


def key_findings(findings: DataFrame, per_dimension: int = 2, limit: int = 10) -> DataFrame:
    """First findings of each dimension, weight notes skipped, in dimension order."""
    order = F.array_position(F.array(*[F.lit(d) for d in K.DIMENSIONS]), F.col("dimension"))
    kept = findings.filter(~F.col("finding").startswith("Content type:")).withColumn("_d", order)
    first = Window.partitionBy("page", "dimension").orderBy("pos")
    overall = Window.partitionBy("page").orderBy("_d", "pos")
    return (
        kept.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_dimension)
        .withColumn("position", F.row_number().over(overall).cast("long")).filter(F.col("position") <= limit)
        .select("page", "position", F.concat(F.lit("["), "dimension", F.lit("] "), "finding").alias("finding"))
    )


# ── summaries ───────────────────────────────────────────────────────────


def code_summary(snippets: DataFrame) -> DataFrame:
    """Per page: snippets, languages, snippets without version information."""
    return snippets.groupBy("page_id").agg(
        F.count("*").alias("snippets"), F.count_if(~F.col("has_version_info")).alias("missing_version"),
        F.array_sort(F.collect_set(F.nullif("language", F.lit("")))).alias("languages"),
    )


def media_summary(media: DataFrame) -> DataFrame:
    t = F.col("media_type")
    return media.groupBy("page_id").agg(
        F.count_if(t == "image").alias("images"), F.count_if(t == "video").alias("videos"), F.count_if(t == "interactive").alias("interactive"),
        F.count_if(F.col("note").contains("accessibility")).alias("accessibility_issues"),
        F.count_if((t == "image") & F.col("alt").isNull()).alias("missing_alt"),
    )


def finding_confidence(findings: DataFrame) -> DataFrame:
    """Deprecated and syntax findings by confidence per page."""
    n = lambda cond: F.count_if(cond)
    return findings.groupBy("page_id").agg(
        n(F.col("kind") == "deprecated").alias("deprecated"), n(F.col("kind") == "syntax").alias("syntax_errors"),
        *[n(F.col("confidence") == x).alias(x) for x in ("high", "medium", "low")],
    )


def legacy_readiness(df: DataFrame) -> DataFrame:
    """Older 100-point score from five yes/no facts and the robots body.

    A crawler counts as allowed when any rule line follows its name: the match
    for ``Allow:`` ignores case and also finds ``Disallow:``.
    """
    body = F.coalesce("body", F.lit(""))
    allowed = F.lit(False)
    for ua in K.LEGACY_AGENTS:
        allowed = allowed | (body.contains(ua) & body.rlike(rf"(?is)User-agent:\s*{ua}.*?Allow:"))
    score = _points(
        (F.col("llms_found"), 30), (F.col("llms_full_found"), 20), (allowed, 20), (F.col("has_jsonld_text"), 15), (F.col("has_md"), 15)
    )
    return df.select("page_id", allowed.alias("allows_ai"), F.least(F.lit(100), score).cast("long").alias("legacy_score"))


def session_status(artifacts: DataFrame) -> DataFrame:
    """State of every session from the artifacts it has written so far."""
    has = lambda k: F.coalesce(F.bool_or(F.col("artifact") == k), F.lit(False))
    facts = artifacts.groupBy("session_id").agg(
        has("sitemap-health").alias("m"), has("report").alias("r"), (has("dimensions") & has("content")).alias("d"),
        F.max(F.when((F.col("artifact") == "status") & F.col("state").isin("failed", "rejected"), F.col("state"))).alias("bad"),
    )
    source = F.when(F.col("m"), "sitemap").when(F.col("r"), "report").when(F.col("d"), "dimensions")
    return facts.select(
        "session_id", F.when(source.isNotNull(), "completed").when(F.col("bad").isNotNull(), "failed").otherwise("in_progress").alias("status"),
        source.alias("source"),
    )


def sitemap_mode_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        "domain", F.col("health_pct").alias("overall"), F.lit(1).cast("long").alias("dimensions_analyzed"), F.lit("high").alias("confidence"),
        "total", "healthy", "broken", "access_denied", "timeouts", "other_errors",
    )


def structure_fallback(sub_pages: Column, content_type: Column, keep_type: bool = False) -> Column:
    kept = content_type if keep_type else F.when(content_type == "product-guide", content_type).otherwise("mixed")
    return F.struct(
        F.when(F.size(sub_pages) > 3, "multi_topic").otherwise("single_topic").alias("structure"),
        F.lit(50).cast("long").alias("confidence"), kept.alias("content_type"),
    )


def report(features: DataFrame, recs: DataFrame, signals: DataFrame) -> DataFrame:
    """One nested row per page: score, grade, features, recommendations, signals."""
    scored = readiness_scores(features)
    listed = recs.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "position", "priority", "category", "rule", rule_text(F.col("rule"), F.col("args"), 0).alias("issue"), rule_text(F.col("rule"), F.col("args"), 1).alias("fix"),
        ))).alias("recommendations")
    )
    facts = [x for x in features.columns if x not in ("page_id", "url")]
    return scored.join(listed, "page_id", "left").join(signals, "page_id", "left").select(
        "page_id", "url", "overall", grade(F.col("overall")).alias("grade"),
        F.struct("discoverability", "consumability", "structured").alias("scores"), F.struct(*facts).alias("features"),
        "recommendations", F.col("site").alias("site_signals"), F.col("page").alias("page_signals"),
        grade_label(F.col("overall"), F.coalesce(F.size("recommendations"), F.lit(0))).alias("label"),
    )
