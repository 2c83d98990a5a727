"""Page-feature columns computed from raw HTML with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import (
    c, contains_any, count_matches, extract, extract_all, map_lookup, round_half_up, squash_ws, str_array, trim_ws,
)

# Text profiles: (blocks removed, what a tag becomes, longest result)
TEXT_PROFILES: dict[str, tuple[Sequence[str], str, int | None]] = {
    "crawl": (("script", "style", "nav", "footer", "header"), " ", None),
    "embed": (("script", "style", "nav", "footer", "header", "aside"), " ", 8000),
    "ratio": (("script", "style"), "", None),
    "words": (("script", "style", "nav", "header", "footer", "aside"), " ", None),
    "site": (("script", "style"), " ", 20000),
}


def drop_blocks(html: Column, tags: Sequence[str]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return html


def strip_tags(col: Column, to: str = "") -> Column:
    return F.regexp_replace(col, "<[^>]+>", to)


def visible_text(html: Column | str, profile: str = "words") -> Column:
    blocks, gap, limit = TEXT_PROFILES[profile]
    text = squash_ws(strip_tags(drop_blocks(c(html), blocks), gap))
    if profile == "embed":
        return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return text if limit is None else F.substring(text, 1, limit)


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+"))).cast("long")


def first_group(col: Column, *patterns: str) -> Column:
    """First pattern that matches wins; null when none does."""
    return F.coalesce(*[extract(col, p) for p in patterns])


def title(html: Column | str) -> Column:
    return trim_ws(strip_tags(F.coalesce(extract(c(html), r"(?is)<title[^>]*>(.*?)</title>"), F.lit(""))))


def h1(html: Column | str) -> Column:
    return trim_ws(strip_tags(F.coalesce(extract(c(html), r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(""))))


def meta_description(html: Column | str) -> Column:
    found = first_group(
        c(html),
        r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']+)[\"']",
        r"(?is)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*name=[\"']description[\"']",
    )
    return trim_ws(F.coalesce(found, F.lit("")))


_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def decode_entities(col: Column, entities: Sequence[tuple[str, str]] = _ENTITIES) -> Column:
    for name, char in entities:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def structured_text(html: Column | str, limit: int = 1500) -> Column:
    """Plain text that keeps headings, bullets and paragraph breaks."""
    t = drop_blocks(c(html), ("script", "style", "nav", "footer", "header"))
    for level in ("1", "2", "3"):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * int(level) + " $1\n")
    t = F.regexp_replace(t, r"(?is)<h[4-6][^>]*>(.*?)</h[4-6]>", "\n#### $1\n")
    t = F.regexp_replace(t, r"(?i)</p>", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    t = decode_entities(strip_tags(t))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, "\n ", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.substring(trim_ws(t), 1, limit)


def structured_view(html: Column | str, limit: int = 2000) -> Column:
    """Text with links, code and images marked, as sent for page-type review."""
    t = c(html)
    for tag in ("nav", "header", "footer", "aside", "script", "style"):
        t = F.regexp_replace(t, rf"(?is)<{tag}.*?</{tag}>", "")
    for opener, mark in (("h1", "#"), ("h2", "##"), ("h3", "###"), ("h[4-6]", "####")):
        t = F.regexp_replace(t, rf"(?is)<{opener}[^>]*>\s*(.*?)\s*</{opener}>", "\n" + mark + " $1\n")
    t = F.regexp_replace(t, r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>\s*</a>", "")
    t = F.regexp_replace(t, r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>\s*(.*?)\s*</a>", "[$2]($1)")
    t = F.regexp_replace(t, r"(?is)<pre[^>]*>\s*(.*?)\s*</pre>", "\n```\n$1\n```\n")
    t = F.regexp_replace(t, r"(?is)<code[^>]*>\s*(.*?)\s*</code>", "`$1`")
    t = F.regexp_replace(t, r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "  • $1\n")
    t = F.regexp_replace(t, r"(?is)<p(?:\s[^>]*)?>\s*(.*?)\s*</p>", "$1\n")
    t = F.regexp_replace(t, r"(?is)<img[^>]*alt=[\"'][\"'][^>]*>", "[image]")
    t = F.regexp_replace(t, r"(?is)<img[^>]*alt=[\"']([^\"']*)[\"'][^>]*>", "[image: $1]")
    t = F.regexp_replace(strip_tags(t, " "), "\n{3,}", "\n\n")
    return F.substring(trim_ws(F.regexp_replace(t, r"[ \t]+", " ")), 1, limit)


def trim_markdown(md: Column | str, limit: int = 1500) -> Column:
    t = F.regexp_replace(c(md), r"(?s)```.{200,}?```", "[code block]")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(strip_tags(t), "\n{3,}", "\n\n")
    return F.substring(trim_ws(t), 1, limit)


def ratio_status(ratio: Column) -> Column:
    return F.when(ratio < 0.15, "very-low").when(ratio < 0.30, "low").otherwise("good")


def js_rendered(html: Column | str, ratio_text: Column) -> Column:
    """Too little markup or text, or an empty application root."""
    empty_root = r"(?i)<div\s+id=[\"'](?:root|app|__next|__nuxt)[\"']\s*>\s*</div>"
    return (F.length(c(html)) < 500) | (F.length(ratio_text) < 100) | c(html).rlike(empty_root)


def headings(html: Column | str) -> Column:
    """Non-empty headings in page order: array of (level, text)."""
    found = extract_all(c(html), r"(?is)<h([1-6])[^>]*>.*?</h\1>", 0)
    pairs = F.transform(
        found,
        lambda m: F.struct(
            F.substring(m, 3, 1).cast("long").alias("level"),
            trim_ws(strip_tags(F.regexp_replace(m, r"(?i)^<h[1-6][^>]*>|</h[1-6]>$", ""))).alias("text"),
        ),
    )
    return F.filter(pairs, lambda h: h["text"] != "")


def heading_count(levels: Column, level: int) -> Column:
    return F.size(F.filter(levels, lambda x: x == level)).cast("long")


def proper_nesting(levels: Column) -> Column:
    """No step deeper than one level between neighbouring headings."""
    following = F.slice(levels, F.lit(2), F.greatest(F.size(levels), F.lit(1)))
    return F.forall(F.zip_with(levels, following, lambda a, b: F.coalesce(b <= a + 1, F.lit(True))), lambda ok: ok)


def code_block_count(html: Column | str) -> Column:
    return count_matches(c(html), r"(?i)<pre[^>]*>")


def language_hint_count(html: Column | str) -> Column:
    hint = (
        r"(?i)<(?:pre|code)[^>]*(?:class=[\"'][^\"']*(?:language-|lang-|highlight-)[^\"']*[\"']"
        r"|language=[\"'][^\"']+[\"'])[^>]*>"
    )
    return F.when(code_block_count(html) > 0, count_matches(c(html), hint)).otherwise(F.lit(0).cast("long"))


def content_html(html: Column | str) -> Column:
    return drop_blocks(c(html), ("nav", "header", "footer", "aside"))


def internal_link_count(content: Column, page_host: Column) -> Column:
    """Links to the page's own host or below it."""
    found = extract_all(content, r"(?i)href=[\"']([^\"']+)[\"']")
    inside = F.filter(
        found,
        lambda h: (h.startswith("/") & ~h.startswith("//"))
        | (h.startswith("http") & ((U.host(h) == page_host) | U.host(h).endswith(F.concat(F.lit("."), page_host)))),
    )
    return F.size(inside).cast("long")


def density_kwords(content: Column) -> Column:
    text = trim_ws(strip_tags(drop_blocks(content, ("script", "style")), " "))
    return F.greatest(F.size(F.split(text, r"\s+")) / F.lit(1000.0), F.lit(0.1))


def density_status(count: Column, per_k: Column) -> Column:
    return F.when((count < 5) | ((count < 20) & (per_k < 5)), "sparse").otherwise("good")


def page_type(html: Column | str, url: Column | str) -> Column:
    h, u = c(html), F.lower(c(url))
    # the slow patterns run on pages that have cells, or a method's name, only
    cells = h.rlike(r"(?i)</?t[hd]")
    method = reduce(lambda x, y: x | y, [h.contains(m) for m in ("GET", "POST", "PUT", "DELETE", "PATCH")])
    api_score = (
        F.when(contains_any(u, K.API_URL_PARTS), 3).otherwise(0)
        + F.when(cells & (count_matches(h, r"(?i)(parameter|param|argument|field|property)\s*</t[hd]>") >= 2), 2).otherwise(0)
        + F.when(
            cells & (count_matches(h, r"(?i)<t[hd][^>]*>\s*(type|returns?|response|request|method|required)\s*</t[hd]>") >= 2), 2
        ).otherwise(0)
        + F.when(cells & (count_matches(h, r"(?i)<td[^>]*>\s*<code") >= 3), 2).otherwise(0)
        + F.when(method & h.rlike(r"\b(GET|POST|PUT|DELETE|PATCH)\s+/"), 2).otherwise(0)
    )
    return (
        F.when(api_score >= 3, "api-reference").when(contains_any(u, K.GUIDE_URL_PARTS), "guide").otherwise("general")
    )


CANONICAL_FORWARD = r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']"
CANONICAL_REVERSED = r"(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"']"


def canonical_url(html: Column | str, forward_only: bool = False) -> Column:
    patterns = [CANONICAL_FORWARD] if forward_only else [CANONICAL_FORWARD, CANONICAL_REVERSED]
    return first_group(c(html), *patterns)


def meta_robots(html: Column | str) -> Column:
    return first_group(
        c(html),
        r"(?i)<meta[^>]*name=[\"']robots[\"'][^>]*content=[\"']([^\"']+)[\"']",
        r"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*name=[\"']robots[\"']",
    )


def blocks_indexing(html: Column | str) -> Column:
    return F.coalesce(F.lower(meta_robots(html)).contains("noindex"), F.lit(False))


def og_tags(html: Column | str) -> Column:
    """Map of OpenGraph tags; the last value of a repeated tag wins."""
    h = c(html)
    forward = r"(?i)<meta[^>]*property=[\"'](og:[^\"']+)[\"'][^>]*content=[\"']([^\"']*)[\"']"
    reverse = r"(?i)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*property=[\"'](og:[^\"']+)[\"']"
    keys = F.concat(extract_all(h, forward, 1), extract_all(h, reverse, 2))
    values = F.concat(extract_all(h, forward, 2), extract_all(h, reverse, 1))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.map_from_entries(
        F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]),
        )
    )


def missing_og(tags: Column) -> Column:
    return F.filter(str_array(K.OG_REQUIRED), lambda t: F.coalesce(F.try_element_at(tags, t), F.lit("")) == "")


def og_completeness(tags: Column) -> Column:
    return F.when(F.size(missing_og(tags)) == 0, "complete").when(F.size(tags) > 0, "partial").otherwise("missing")


_JSONLD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def jsonld_blocks(html: Column | str) -> Column:
    return extract_all(c(html), _JSONLD)


def valid_json(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())


def jsonld_types(blocks: Column) -> Column:
    """Distinct ``@type`` values in order; arrays are flattened."""
    raw = F.transform(valid_json(blocks), lambda b: F.get_json_object(b, "$.@type"))
    lists = F.transform(
        F.filter(raw, lambda t: t.isNotNull() & (t != "")),
        lambda t: F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t)),
    )
    return F.array_distinct(F.flatten(lists))


def jsonld_fields(blocks: Column) -> Column:
    keys = F.transform(valid_json(blocks), lambda b: F.json_object_keys(b))
    return F.array_distinct(F.flatten(F.filter(keys, lambda k: k.isNotNull())))


def valid_schema(types: Column) -> Column:
    return F.arrays_overlap(types, str_array(K.SCHEMA_TYPES))


def required_fields(primary: Column) -> Column:
    pairs = [x for k, v in K.SCHEMA_REQUIRED.items() for x in (F.lit(k), str_array(v))]
    return F.try_element_at(F.create_map(*pairs), primary)


def missing_fields(types: Column, fields: Column) -> Column:
    needed = required_fields(F.get(types, F.lit(0)))
    return F.coalesce(F.array_except(needed, fields), F.array().cast("array<string>"))


def schema_status(types: Column, missing: Column) -> Column:
    return F.when(F.size(types) == 0, "missing").when(F.size(missing) == 0, "complete").otherwise("partial")


def has_breadcrumbs(html: Column | str) -> Column:
    h = c(html)
    return h.contains("BreadcrumbList") | (h.contains("breadcrumb") & h.contains("application/ld+json"))


MD_ALTERNATES = [
    r"(?i)<link[^>]*rel=[\"']alternate[\"'][^>]*type=[\"']text/markdown[\"'][^>]*href=[\"']([^\"']+)[\"']",
    r"(?i)<link[^>]*type=[\"']text/markdown[\"'][^>]*rel=[\"']alternate[\"'][^>]*href=[\"']([^\"']+)[\"']",
    r"(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']alternate[\"'][^>]*type=[\"']text/markdown[\"']",
]


def site_join(base: Column, href: Column) -> Column:
    """Site-relative form used for markdown links: no dot-segment handling."""
    gap = F.when(href.startswith("/"), "").otherwise("/")
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, gap, href))


def md_alternate(html: Column | str) -> Column:
    """Target of a markdown alternate link in either short attribute order."""
    return first_group(c(html), *MD_ALTERNATES[:2])


def md_link_urls(html: Column | str, base: Column, limit: int = 3) -> Column:
    found = F.slice(extract_all(c(html), r"(?i)href=[\"']([^\"']*\.md)[\"']"), 1, limit)
    return F.transform(found, lambda h: site_join(base, h))


# ── media and code ──────────────────────────────────────────────────────


def attr(tag: Column, name: str) -> Column:
    return extract(tag, rf"(?is)\s{name}=[\"']([^\"']*)[\"']")


def media_items(html: Column | str, url: Column | str) -> Column:
    """Images, then videos, then interactive elements, each in page order."""
    h = c(html)

    def item(kind, src, alt, caption, note):
        return F.struct(
            F.lit(kind).alias("type"), src.alias("src"), alt.alias("alt"), caption.alias("caption"), note.alias("note")
        )

    none = F.lit(None).cast("string")
    images = F.transform(
        extract_all(h, r"(?is)<img\s[^>]*>", 0),
        lambda m: item(
            "image",
            F.coalesce(U.resolve_url(attr(m, "src"), url), F.lit("")),
            F.nullif(attr(m, "alt"), F.lit("")),
            F.nullif(attr(m, "title"), F.lit("")),
            F.when(F.coalesce(attr(m, "alt"), F.lit("")) != "", "alternative text given").otherwise(
                "image without alternative text"
            ),
        ),
    )
    videos = F.transform(
        extract_all(h, r"(?is)<video(?:\s[^>]*)?>|<iframe\s[^>]*src=[\"'][^\"']*(?:youtube|vimeo)[^\"']*[\"'][^>]*>", 0),
        lambda m: item(
            "video", F.coalesce(attr(m, "src"), F.lit("")), none, none,
            F.lit("moving picture: captions and size to be checked"),
        ),
    )
    interactive = F.transform(
        extract_all(h, r"(?is)<form(?:\s[^>]*)?>|<button\s[^>]*onclick[^>]*>|<(?!form|button)\w+\s[^>]*data-interactive[^>]*>", 0),
        lambda m: item(
            "interactive", F.lit(""), none, none, F.lit("part that reacts to input")
        ),
    )
    return F.concat(images, videos, interactive)


def language_from_class(cls: Column) -> Column:
    named = F.lower(extract(cls, r"(?:lang-|language-)([a-zA-Z0-9]+)"))
    return (
        F.when(named.isNotNull(), named)
        .when(cls.contains("php"), "php")
        .when(cls.contains("js") | cls.contains("javascript"), "javascript")
        .when(cls.contains("css"), "css")
        .when(cls.contains("html"), "html")
        .otherwise("")
    )


def language_from_code(code: Column) -> Column:
    return (
        F.when(code.contains("<?php") | code.contains("->"), "php")
        .when(code.contains("function") | code.contains("const ") | code.contains("=>"), "javascript")
        .when(code.contains("{") & code.contains(":") & code.contains(";"), "css")
        .when(code.contains("<") & code.contains(">"), "html")
        .otherwise("text")
    )


# Fixed value: what counts as a version note
VERSION_INFO = r"(?i)since\s+wordpress\s+\d+\.\d+|wp\s+\d+\.\d+|version\s+\d+\.\d+|@since\s+\d+\.\d+"


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def code_snippets(html: Column | str, code_chars: int | None = 1000) -> Column:
    """Code elements of at least 10 characters, with language and version flag; ``code_chars`` cuts the code itself."""
    found = extract_all(c(html), r"(?is)<code(?:\s[^>]*)?>.*?</code>", 0)
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            (i + 1).cast("long").alias("line_number"),
            F.coalesce(attr(extract(m, r"(?is)^(<code[^>]*>)"), "class"), F.lit("")).alias("cls"),
            decode_entities(strip_tags(m)).alias("code"),
        ),
    )
    kept = F.filter(rows, lambda r: F.length(trim_ws(r["code"])) >= 10)
    return F.transform(
        kept,
        lambda r: F.struct(
            r["line_number"].alias("line_number"),
            F.coalesce(F.nullif(language_from_class(r["cls"]), F.lit("")), language_from_code(r["code"])).alias("language"),
            (trim_ws(r["code"]) if code_chars is None else F.substring(trim_ws(r["code"]), 1, code_chars)).alias("code"),
            r["code"].rlike(VERSION_INFO).alias("has_version_info"),
        ),
    )


_CODE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]


def post_code_snippets(html: Column | str, shorter_than: int | None = 1000, first: int | None = 5) -> Column:
    """Fenced code of a discussion page: over 20 and under ``shorter_than`` characters, the ``first`` ones; None is no limit."""
    found = extract_all(c(html), r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>")
    code = F.transform(found, lambda m: trim_ws(decode_entities(strip_tags(m), _CODE_ENTITIES)))
    fits = lambda s: (F.length(s) > 20) if shorter_than is None else (F.length(s) > 20) & (F.length(s) < shorter_than)
    return _first(F.filter(code, fits), first)


def likely_code_snippets(html: Column | str) -> Column:
    """Language-tagged fences plus other code elements that look like code."""
    fenced = F.filter(
        F.transform(
            extract_all(c(html), r"(?is)<pre[^>]*><code[^>]*class=[\"']?language-\w+[\"']?[^>]*>(.*?)</code></pre>"),
            lambda m: trim_ws(strip_tags(decode_entities(m, _CODE_ENTITIES))),
        ),
        lambda s: F.length(s) > 10,
    )
    other = F.filter(
        F.transform(
            extract_all(c(html), r"(?is)<code[^>]*>(.*?)</code>"),
            lambda m: trim_ws(strip_tags(decode_entities(m, _CODE_ENTITIES))),
        ),
        lambda s: (F.length(s) > 40) | contains_any(s, ["{", "=>", ";", "import ", "const "]),
    )
    return F.array_distinct(F.concat(fenced, other))


def is_simple_code(code: Column | str) -> Column:
    """Short or declarative code that needs no review."""
    t = trim_ws(c(code))
    lines = F.size(F.split(t, "\n"))
    return (
        (F.length(t) < 20)
        | (t.contains("{") & t.contains(":") & t.contains(";") & ~t.contains("function"))
        | (t.startswith("<") & t.endswith(">") & (lines < 3))
        | (t.contains("=") & ~t.contains("function") & ~t.contains("class") & (lines < 5))
    )


def unreadable_reason(markdown: Column | str) -> Column:
    """Why a page cannot be audited; null when it can."""
    t = trim_ws(c(markdown))
    loading = "(?i)^(" + "|".join(K.LOADING_PREFIXES) + ")"
    return F.when(F.length(t) < 100, "insufficient-content").when(t.rlike(loading), "loading-state")


def type_by_keyword(url: Column | str, page_title: Column | str) -> Column:
    u, t = F.lower(c(url)), F.lower(c(page_title))
    both = F.concat(u, F.lit(" "), t)
    result = F.when(U.is_non_doc_url(u), F.lit("non-documentation"))
    for kind, anywhere, in_title in K.KEYWORD_PAGE_TYPES:
        result = result.when(contains_any(both, anywhere) | contains_any(t, in_title), kind)
    return result


def model_page_type(answer: Column) -> Column:
    cleaned = F.lower(trim_ws(answer))
    return F.when(cleaned.isin(K.MODEL_PAGE_TYPES), cleaned).otherwise("mixed")


def doc_signals(html: Column | str, url: Column | str) -> Column:
    """Signals that fired: array of (name, weight)."""
    h, u = c(html), c(url)
    low_u = F.lower(u)
    body = h
    for tag in ("nav", "header", "footer", "aside"):
        body = F.regexp_replace(body, rf"(?is)<{tag}.*?</{tag}>", "")
    pre = count_matches(h, r"(?i)<pre[\s>]")
    inline = count_matches(h, r"(?i)<code[\s>]")
    installs = h.rlike("(?i)" + K.DOC_INSTALL_PATTERN)
    cards = (count_matches(h, "(?i)" + K.DOC_CARD_GRID_PATTERN) >= 2) | (count_matches(h, "(?i)" + K.DOC_CARD_PATTERN) >= 6)
    prose = F.size(
        F.filter(extract_all(body, r"(?is)<p[\s>].*?</p>", 0), lambda p: F.length(trim_ws(strip_tags(p))) > 80)
    )
    technical = (pre > 0) | (inline >= 3) | installs | h.rlike("(?i)" + K.DOC_API_WORDS_PATTERN)
    fired = [(n, w, low_u.rlike("(?i)" + p)) for n, w, p in K.DOC_URL_SIGNALS]
    earlier = F.lit(False)
    for n, w, p in K.DOC_PLATFORM_SIGNALS:
        fired.append((n, w, h.rlike("(?i)" + p) & ~earlier))
        earlier = earlier | h.rlike("(?i)" + p)
    fired += [(n, w, h.rlike("(?i)" + p)) for n, w, p in K.DOC_HTML_SIGNALS]
    fired += [(n, w, count_matches(h, "(?i)" + p) >= least) for n, w, p, least in K.DOC_COUNT_SIGNALS]
    fired += [
        ("in-content anchors", 3, count_matches(body, "(?i)" + K.DOC_ANCHOR_PATTERN) >= 5),
        ("card listing", -3, cards),
        ("image gallery", -2, (count_matches(h, r"(?i)<img[\s>]") >= 10) & (count_matches(h, r"(?i)<p[\s>]") < 5)),
        ("many buttons", -1, (count_matches(h, r"(?i)<button[\s>]") >= 5) & (pre == 0)),
        ("link hub", -3, (count_matches(body, "(?i)" + K.DOC_OUTBOUND_PATTERN) >= 8) & (prose <= 2)),
        ("no technical content", -1, ~technical),
    ]
    rows = F.array(
        *[F.when(cond, F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, cond in fired]
    )
    return F.filter(rows, lambda s: s.isNotNull())


def doc_confidence(signals: Column, url: Column | str) -> Column:
    """Logistic of the signal sum in two decimals; a bare root page is 0."""
    total = F.aggregate(signals, F.lit(0), lambda a, s: a + s["weight"])
    root = ~U.is_absolute(url) | F.regexp_replace(U.path(url), "/+$", "").isin("")
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.7) * total))
    return F.when(root, F.lit(0.0)).otherwise(round_half_up(logistic * 100) / 100)


# ── response headers ────────────────────────────────────────────────────


def header(headers: Column, name: str) -> Column:
    """Header value by lowercase or capitalised name, '' when absent."""
    title_case = "-".join(p.capitalize() for p in name.split("-"))
    lower = F.nullif(F.try_element_at(headers, F.lit(name)), F.lit(""))
    return F.coalesce(lower, F.try_element_at(headers, F.lit(title_case)), F.lit(""))


def header_hints(headers: Column, base: Column) -> Column:
    link = header(headers, "link")
    resolve = lambda x: U.resolve_url(x, base)
    rel = lambda name: F.transform(extract_all(link, rf"(?i)<([^>]+)>;\s*[^,]*rel=\"{name}\""), resolve)
    x_llms = header(headers, "x-llms-txt")
    md = extract(
        link,
        r"(?i)<([^>]+)>;\s*[^,]*(?:rel=\"alternate\"[^,]*type=\"text/markdown\"|type=\"text/markdown\"[^,]*rel=\"alternate\")",
    )
    robots = header(headers, "x-robots-tag")
    return F.struct(
        F.concat(rel("llms-txt"), F.when(x_llms != "", F.array(resolve(x_llms))).otherwise(F.array().cast("array<string>"))).alias("llms_hints"),
        rel("llms-full-txt").alias("llms_full_hints"),
        resolve(md).alias("md_header_url"),
        F.lower(header(headers, "vary")).contains("accept").alias("vary_accept"),
        F.nullif(robots, F.lit("")).alias("x_robots_tag"),
    )


# ── discussion pages ────────────────────────────────────────────────────

# What counts as an error message
ERROR_PATTERNS = [
    r"Error:\s*([^\n]{10,100})",
    r"Exception:\s*([^\n]{10,100})",
    r"Failed:\s*([^\n]{10,100})",
    r"\d{3}\s+error[:\s]+([^\n]{10,100})",
    r"TypeError:\s*([^\n]{10,100})",
    r"ReferenceError:\s*([^\n]{10,100})",
    r"SyntaxError:\s*([^\n]{10,100})",
]


def error_messages(html: Column | str, first: int | None = 3) -> Column:
    """Distinct messages of the patterns, the ``first`` ones; None is no limit, here and below."""
    text = strip_tags(c(html), " ")
    found = F.concat(*[extract_all(text, "(?i)" + p) for p in ERROR_PATTERNS])
    return _first(F.array_distinct(F.transform(found, trim_ws)), first)


def post_tags(html: Column | str) -> Column:
    return F.transform(
        extract_all(c(html), r"(?i)<a[^>]*class=\"[^\"]*post-tag[^\"]*\"[^>]*>([^<]+)</a>"), trim_ws
    )


def stack_trace(html: Column | str, first: int | None = 5) -> Column:
    """The ``first`` frames of a trace of more than two."""
    frames = extract_all(strip_tags(c(html), "\n"), r"(?i)at\s+[\w.$]+\s*\([^)]+\)", 0)
    return F.when(F.size(frames) > 2, F.array_join(_first(frames, first), "\n"))


def related_pages(text: Column | str, first: int | None = 3) -> Column:
    """The ``first`` documentation paths that a text names."""
    return _first(extract_all(c(text), r"/docs/[^\s)]+", 0), first)


def post_bodies(html: Column | str, first: int | None = 3) -> Column:
    """The question and the answers of a discussion page, the ``first`` of them."""
    found = extract_all(
        c(html), r"(?is)<div class=\"s-prose js-post-body\"[^>]*itemprop=\"text\">(.*?)</div>\s*</div>"
    )
    return _first(found, first)


def main_text(html: Column | str) -> Column:
    """Visible text of the main content: the first ``main`` block, else the first ``article``, else the whole page."""
    h = c(html)
    block = F.coalesce(extract(h, r"(?is)<main(?:\s[^>]*)?>(.*?)</main>"), extract(h, r"(?is)<article(?:\s[^>]*)?>(.*?)</article>"), h)
    return visible_text(block, "crawl")
