"""Registered queries over page markup and markdown text."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions import text as T
from doccensus.operators import pages as PG
from doccensus.functions import urls as U
from doccensus.plans import oracle_frag as D
from doccensus.plans.inputs import oracle_table, spark_table

QUERIES: dict = {}
ORACLE: dict = {}
AP = oracle_table("audit_pages")
MD = oracle_table("markdown_docs")
POSTS = oracle_table("posts")
Q2 = "[\"'']"  # either quote, inside a SQL literal
NQ2 = "[^\"'']"


def _on(table, key):
    def register(name, sql, **cols):
        QUERIES[name] = lambda spark, sf: spark_table(spark, sf, table).select(
            key, *[fn().alias(k) for k, fn in cols.items()]
        )
        ORACLE[name] = sql

    return register


_page, _md, _post = _on("audit_pages", "page_id"), _on("markdown_docs", "doc_id"), _on("posts", "doc_id")


def drop(x, tags, opener="[^>]*>"):
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}{opener}.*?</{t}>', '', 'g')"
    return x


def strip(x, to=""):
    return f"regexp_replace({x}, '<[^>]+>', '{to}', 'g')"


def ext(x, p, g=1):
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', {g}) END"


WORDS_TEXT = D.squash(strip(drop("html", ["script", "style", "nav", "header", "footer", "aside"]), " "))
RATIO_TEXT = D.squash(strip(drop("html", ["script", "style"])))
EMBED_TEXT = D.squash(strip(drop("html", ["script", "style", "nav", "footer", "header", "aside"]), " "))
WORDS = rf"CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END"

_page(
    "h1_visible_text",
    f"""SELECT page_id, {D.squash(strip(drop('html', ['script', 'style', 'nav', 'footer', 'header']), ' '))} AS crawl,
    CASE WHEN length({EMBED_TEXT}) > 8000 THEN left({EMBED_TEXT}, 8000) || '...' ELSE {EMBED_TEXT} END AS embed,
    {RATIO_TEXT} AS ratio, {WORDS_TEXT} AS words, left({D.squash(strip(drop('html', ['script', 'style']), ' '))}, 20000) AS site FROM {AP}""",
    **{p: (lambda p=p: H.visible_text("html", p)) for p in H.TEXT_PROFILES},
)

TITLE = D.trim(strip(f"coalesce({ext('html', '(?is)<title[^>]*>(.*?)</title>')}, '')"))
H1 = D.trim(strip(f"coalesce({ext('html', '(?is)<h1[^>]*>(.*?)</h1>')}, '')"))
META_D = D.trim(
    f"""coalesce({ext('html', f'(?is)<meta[^>]*name={Q2}description{Q2}[^>]*content={Q2}({NQ2}+){Q2}')},
    {ext('html', f'(?is)<meta[^>]*content={Q2}({NQ2}+){Q2}[^>]*name={Q2}description{Q2}')}, '')"""
)
_page(
    "h2_title_h1_description",
    f"SELECT page_id, {TITLE} AS title, {H1} AS h1, {META_D} AS description FROM {AP}",
    title=lambda: H.title("html"),
    h1=lambda: H.h1("html"),
    description=lambda: H.meta_description("html"),
)


def _entities(x, names=("&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;")):
    chars = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " "}
    for n in names:
        x = f"replace({x}, '{n}', '{chars[n]}')"
    return x


def _structured():
    x = drop("html", ["script", "style", "nav", "footer", "header"])
    for lv, mark in (("1", "#"), ("2", "##"), ("3", "###")):
        x = rf"regexp_replace({x}, '(?is)<h{lv}[^>]*>(.*?)</h{lv}>', chr(10) || '{mark} \1' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<h[4-6][^>]*>(.*?)</h[4-6]>', chr(10) || '#### \1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?i)</p>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?i)<br\s*/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<li[^>]*>(.*?)</li>', '- \1' || chr(10), 'g')"
    x = _entities(strip(x))
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n ', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"left({D.trim(x)}, 1500)"


def _view():
    x = drop("html", ["nav", "header", "footer", "aside", "script", "style"], "")
    for op, mark in (("h1", "#"), ("h2", "##"), ("h3", "###"), ("h[4-6]", "####")):
        x = rf"regexp_replace({x}, '(?is)<{op}[^>]*>\s*(.*?)\s*</{op}>', chr(10) || '{mark} \1' || chr(10), 'g')"
    a = f"(?is)<a\\s[^>]*href={Q2}({NQ2}*){Q2}[^>]*>"
    x = rf"regexp_replace({x}, '{a}\s*</a>', '', 'g')"
    x = rf"regexp_replace({x}, '{a}\s*(.*?)\s*</a>', '[\2](\1)', 'g')"
    x = rf"regexp_replace({x}, '(?is)<pre[^>]*>\s*(.*?)\s*</pre>', chr(10) || '```' || chr(10) || '\1' || chr(10) || '```' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<code[^>]*>\s*(.*?)\s*</code>', '`\1`', 'g')"
    x = rf"regexp_replace({x}, '(?is)<li[^>]*>\s*(.*?)\s*</li>', '  • \1' || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<p(?:\s[^>]*)?>\s*(.*?)\s*</p>', '\1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?is)<img[^>]*alt={Q2}{Q2}[^>]*>', '[image]', 'g')"
    x = rf"regexp_replace({x}, '(?is)<img[^>]*alt={Q2}({NQ2}*){Q2}[^>]*>', '[image: \1]', 'g')"
    x = rf"regexp_replace({strip(x, ' ')}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"left({D.trim(rf'''regexp_replace({x}, '[ {chr(92)}t]+', ' ', 'g')''')}, 2000)"


_page(
    "h3_structured_text",
    f"SELECT page_id, {_structured()} AS structured, {_view()} AS review_view FROM {AP}",
    structured=lambda: H.structured_text("html"),
    review_view=lambda: H.structured_view("html"),
)

_FENCES = r"regexp_replace(md, '(?s)```.{200,}?```', '[code block]', 'g')"
_md(
    "h4_trim_markdown",
    rf"""SELECT doc_id, left({D.trim(rf"regexp_replace({strip(rf'''regexp_replace(regexp_replace({_FENCES}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')''')}, '\n{{3,}}', chr(10) || chr(10), 'g')")}, 1500) AS trimmed FROM {MD}""",
    trimmed=lambda: H.trim_markdown("md"),
)

_RATIO = "CAST(strlen(r) AS DOUBLE) / strlen(html)"


def _h5(spark, sf):
    p = spark_table(spark, sf, "audit_pages").withColumn("r", H.visible_text("html", "ratio"))
    ratio = F.octet_length("r") / F.octet_length("html")
    return p.select(
        "page_id", F.octet_length("r").cast("long").alias("text_bytes"), F.octet_length("html").cast("long").alias("html_bytes"),
        F.round(ratio, 6).alias("ratio"), H.ratio_status(ratio).alias("ratio_status"),
    )


QUERIES["h5_text_ratio"] = _h5
ORACLE["h5_text_ratio"] = f"""SELECT page_id, CAST(strlen(r) AS BIGINT) AS text_bytes, CAST(strlen(html) AS BIGINT) AS html_bytes, round({_RATIO}, 6) AS ratio,
  CASE WHEN {_RATIO} < 0.15 THEN 'very-low' WHEN {_RATIO} < 0.30 THEN 'low' ELSE 'good' END AS ratio_status
  FROM (SELECT page_id, html, {RATIO_TEXT} AS r FROM {AP})"""

JS = rf"(length(html) < 500 OR length({RATIO_TEXT}) < 100 OR regexp_matches(html, '(?i)<div\s+id={Q2}(?:root|app|__next|__nuxt){Q2}\s*>\s*</div>'))"
_page(
    "h6_js_rendered",
    f"SELECT page_id, {JS} AS js_rendered FROM {AP}",
    js_rendered=lambda: H.js_rendered("html", H.visible_text("html", "ratio")),
)

_HALT = "(?is)" + "|".join(f"<h{i}[^>]*>.*?</h{i}>" for i in range(1, 7))
HEADS = rf"""list_filter(list_transform(regexp_extract_all(html, '{_HALT}'), lambda m: {{'level': CAST(substring(m, 3, 1) AS BIGINT),
  'text': {D.trim(strip("regexp_replace(m, '(?i)^<h[1-6][^>]*>|</h[1-6]>$', '', 'g')"))}}}), lambda h: h.text <> '')"""
NESTED = "NOT list_contains(list_transform(range(2, len(h) + 1), lambda i: h[i].level > h[i - 1].level + 1), true)"


def _level(n):
    return f"CAST(len(list_filter(h, lambda x: x.level = {n})) AS BIGINT)"


def _h7(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", H.headings("html").alias("h"))
    lv = F.col("h.level")
    return p.select(
        "page_id", *[H.heading_count(lv, i).alias(f"h{i}_count") for i in (1, 2, 3)], H.proper_nesting(lv).alias("proper_nesting"),
        F.array_join(F.transform(F.slice("h", 1, 20), lambda x: F.concat(F.lit("H"), x["level"], F.lit(": "), F.substring(x["text"], 1, 80))), "|").alias("headings"),
    )


QUERIES["h7_headings"] = _h7
ORACLE["h7_headings"] = f"""SELECT page_id, {_level(1)} AS h1_count, {_level(2)} AS h2_count, {_level(3)} AS h3_count, {NESTED} AS proper_nesting,
  array_to_string(list_transform(h[1:20], lambda x: 'H' || x.level || ': ' || left(x.text, 80)), '|') AS headings
  FROM (SELECT page_id, {HEADS} AS h FROM {AP})"""

PRE = D.nmatch("html", "(?i)<pre[^>]*>")
HINT = D.nmatch("html", f"(?i)<(?:pre|code)[^>]*(?:class={Q2}{NQ2}*(?:language-|lang-|highlight-){NQ2}*{Q2}|language={Q2}{NQ2}+{Q2})[^>]*>")
_page(
    "h8_code_blocks",
    f"SELECT page_id, {PRE} AS code_blocks, CASE WHEN {PRE} > 0 THEN {HINT} ELSE 0 END AS with_hint, {PRE} > 0 AS has_code FROM {AP}",
    code_blocks=lambda: H.code_block_count("html"),
    with_hint=lambda: H.language_hint_count("html"),
    has_code=lambda: H.code_block_count("html") > 0,
)

_CONTENT = drop("html", ["nav", "header", "footer", "aside"])
LINKS_SQL = rf"""(SELECT page_id, n, CASE WHEN n < 5 OR (n < 20 AND n / k < 5) THEN 'sparse' ELSE 'good' END AS density_status, floor(n / k * 10 + 0.5) / 10 AS per_k_words FROM (
  SELECT page_id, CAST(len(list_filter(regexp_extract_all(ch, '(?i)href={Q2}({NQ2}+){Q2}', 1), lambda x: (x LIKE '/%' AND x NOT LIKE '//%')
     OR (x LIKE 'http%' AND ({D.host('x')} = hh OR suffix({D.host('x')}, '.' || hh))))) AS BIGINT) AS n,
   greatest(len(string_split_regex({D.trim(strip(drop('ch', ['script', 'style']), ' '))}, '\s+')) / CAST(1000 AS DOUBLE), CAST(0.1 AS DOUBLE)) AS k
  FROM (SELECT page_id, {D.host('url')} AS hh, {_CONTENT} AS ch FROM {AP})))"""


def _h9(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", U.host("url").alias("hh"), H.content_html("html").alias("ch"))
    n = H.internal_link_count(F.col("ch"), F.col("hh"))
    p = p.select("page_id", n.alias("n"), H.density_kwords(F.col("ch")).alias("k"))
    per_k = F.col("n") / F.col("k")
    return p.select(
        "page_id", F.col("n").alias("internal_links"), (F.floor(per_k * 10 + 0.5) / 10).alias("per_k_words"),
        H.density_status(F.col("n"), per_k).alias("density_status"),
    )


QUERIES["h9_link_density"] = _h9
ORACLE["h9_link_density"] = f"SELECT page_id, n AS internal_links, per_k_words, density_status FROM {LINKS_SQL}"

_API = rf"""(CASE WHEN regexp_matches(lower(url), '{D.alt(K.API_URL_PARTS)}') THEN 3 ELSE 0 END
 + CASE WHEN {D.nmatch('html', r'(?i)(parameter|param|argument|field|property)\s*</t[hd]>')} >= 2 THEN 2 ELSE 0 END
 + CASE WHEN {D.nmatch('html', r'(?i)<t[hd][^>]*>\s*(type|returns?|response|request|method|required)\s*</t[hd]>')} >= 2 THEN 2 ELSE 0 END
 + CASE WHEN {D.nmatch('html', r'(?i)<td[^>]*>\s*<code')} >= 3 THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(html, '\b(GET|POST|PUT|DELETE|PATCH)\s+/') THEN 2 ELSE 0 END)"""
PAGE_TYPE = f"CASE WHEN {_API} >= 3 THEN 'api-reference' WHEN regexp_matches(lower(url), '{D.alt(K.GUIDE_URL_PARTS)}') THEN 'guide' ELSE 'general' END"
_page("h10_page_type", f"SELECT page_id, {PAGE_TYPE} AS page_type FROM {AP}", page_type=lambda: H.page_type("html", "url"))

_CF = ext("html", f"(?i)<link[^>]*rel={Q2}canonical{Q2}[^>]*href={Q2}({NQ2}+){Q2}")
_CR = ext("html", f"(?i)<link[^>]*href={Q2}({NQ2}+){Q2}[^>]*rel={Q2}canonical{Q2}")
ROBOTS_META = f"coalesce({ext('html', f'(?i)<meta[^>]*name={Q2}robots{Q2}[^>]*content={Q2}({NQ2}+){Q2}')}, {ext('html', f'(?i)<meta[^>]*content={Q2}({NQ2}+){Q2}[^>]*name={Q2}robots{Q2}')})"
NOINDEX = f"coalesce(contains(lower({ROBOTS_META}), 'noindex'), false)"
_page(
    "h11_canonical_robots",
    f"SELECT page_id, coalesce({_CF}, {_CR}) AS canonical_url, {ROBOTS_META} AS meta_robots, {NOINDEX} AS blocks_indexing FROM {AP}",
    canonical_url=lambda: H.canonical_url("html"),
    meta_robots=lambda: H.meta_robots("html"),
    blocks_indexing=lambda: H.blocks_indexing("html"),
)

_OGF = f"(?i)<meta[^>]*property={Q2}(og:{NQ2}+){Q2}[^>]*content={Q2}({NQ2}*){Q2}"
_OGR = f"(?i)<meta[^>]*content={Q2}({NQ2}*){Q2}[^>]*property={Q2}(og:{NQ2}+){Q2}"
OG_ROWS = f"""(SELECT page_id, k, arg_max(v, i) AS v FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '{_OGF}', 1)) AS k, unnest(regexp_extract_all(html, '{_OGF}', 2)) AS v, generate_subscripts(regexp_extract_all(html, '{_OGF}', 1), 1) AS i FROM {AP}
  UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '{_OGR}', 2)), unnest(regexp_extract_all(html, '{_OGR}', 1)), 1000000 + generate_subscripts(regexp_extract_all(html, '{_OGR}', 1), 1) FROM {AP}) GROUP BY page_id, k)"""


def _h12(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", H.og_tags("html").alias("og"))
    return p.select("page_id", F.explode("og").alias("tag", "content"))


QUERIES["h12_og_tags"] = _h12
ORACLE["h12_og_tags"] = f"SELECT page_id, k AS tag, v AS content FROM {OG_ROWS}"

OG_SCORE = f"""(SELECT page_id, CASE WHEN count(DISTINCT CASE WHEN v <> '' THEN r END) = 4 THEN 'complete' WHEN count(k) > 0 THEN 'partial' ELSE 'missing' END AS og_status,
  array_to_string(list_filter({D.lst(K.OG_REQUIRED)}, lambda t: NOT list_contains(coalesce(list(r) FILTER (v <> ''), []), t)), ',') AS missing_tags
  FROM (SELECT p.page_id, k, v, CASE WHEN k IN ({D.q(K.OG_REQUIRED)}) THEN k END AS r FROM {AP} p LEFT JOIN {OG_ROWS} o ON p.page_id = o.page_id) GROUP BY page_id)"""


def _h13(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", H.og_tags("html").alias("og"))
    return p.select("page_id", H.og_completeness(F.col("og")).alias("og_status"), F.array_join(H.missing_og(F.col("og")), ",").alias("missing_tags"))


QUERIES["h13_og_completeness"] = _h13
ORACLE["h13_og_completeness"] = f"SELECT page_id, og_status, missing_tags FROM {OG_SCORE}"

_BLOCKS = f"regexp_extract_all(html, '(?is)<script[^>]*type={Q2}application/ld\\+json{Q2}[^>]*>(.*?)</script>', 1)"
_TYPES = """list_filter(flatten(list_transform(list_filter({b}, lambda b: json_valid(b)), lambda b:
  CASE WHEN json_type(b, '$."@type"') = 'ARRAY' THEN CAST(json_extract_string(b, '$."@type"[*]') AS VARCHAR[]) ELSE [json_extract_string(b, '$."@type"')] END)), lambda t: t IS NOT NULL)"""
_DISTINCT = "list_filter({x}, lambda dx, di: list_position({x}, dx) = di)"
SCHEMA_ROWS = f"""(SELECT page_id, html, len(b) > 0 AS has_jsonld, {_DISTINCT.format(x='t')} AS types, list_sort(list_distinct(f)) AS fields FROM (
  SELECT page_id, html, b, {_TYPES.format(b='b')} AS t, flatten(list_transform(list_filter(b, lambda b: json_valid(b)), lambda b: json_keys(b))) AS f FROM (SELECT page_id, html, {_BLOCKS} AS b FROM {AP})))"""
_REQ = "CASE " + " ".join(f"WHEN types[1] = '{k}' THEN {D.lst(v)}" for k, v in K.SCHEMA_REQUIRED.items()) + " ELSE [] END"
MISSING_F = f"list_filter({_REQ}, lambda f: NOT list_contains(fields, f))"
SCHEMA_STATUS = f"CASE WHEN len(types) = 0 THEN 'missing' WHEN len({MISSING_F}) = 0 THEN 'complete' ELSE 'partial' END"


def _schema(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", "html", H.jsonld_blocks("html").alias("b"))
    return p.withColumn("types", H.jsonld_types(F.col("b"))).withColumn("fields", H.jsonld_fields(F.col("b")))


QUERIES["h14_jsonld"] = lambda spark, sf: _schema(spark, sf).select(
    "page_id", (F.size("b") > 0).alias("has_jsonld"), F.array_join("types", ",").alias("types"),
    F.array_join(F.array_sort("fields"), ",").alias("fields"), H.valid_schema(F.col("types")).alias("valid_schema"),
)
ORACLE["h14_jsonld"] = f"""SELECT page_id, has_jsonld, array_to_string(types, ',') AS types, array_to_string(fields, ',') AS fields,
  len(list_intersect(types, {D.lst(K.SCHEMA_TYPES)})) > 0 AS valid_schema FROM {SCHEMA_ROWS}"""


def _h15(spark, sf):
    p = _schema(spark, sf).withColumn("m", H.missing_fields(F.col("types"), F.col("fields")))
    return p.select("page_id", H.schema_status(F.col("types"), F.col("m")).alias("schema_status"), F.array_join("m", ",").alias("missing_fields"))


QUERIES["h15_schema_completeness"] = _h15
ORACLE["h15_schema_completeness"] = f"SELECT page_id, {SCHEMA_STATUS} AS schema_status, array_to_string({MISSING_F}, ',') AS missing_fields FROM {SCHEMA_ROWS}"

CRUMBS = "(contains(html, 'BreadcrumbList') OR (contains(html, 'breadcrumb') AND contains(html, 'application/ld+json')))"
_page("h16_breadcrumbs", f"SELECT page_id, {CRUMBS} AS has_breadcrumbs FROM {AP}", has_breadcrumbs=lambda: H.has_breadcrumbs("html"))

_MEDIA_KINDS = [
    ("image", r"(?is)<img\s[^>]*>"),
    ("video", f"(?is)<video(?:\\s[^>]*)?>|<iframe\\s[^>]*src={Q2}{NQ2}*(?:youtube|vimeo){NQ2}*{Q2}[^>]*>"),
    ("interactive", r"(?is)<form(?:\s[^>]*)?>"),
]


def _attr(n):
    return ext("m", f"(?is)\\s{n}={Q2}({NQ2}*){Q2}")


def _h19(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", F.explode(H.media_items("html", "url")).alias("m"))
    return p.select("page_id", F.col("m.type").alias("media_type"), F.col("m.src").alias("src"), F.col("m.alt").alias("alt"), F.col("m.caption").alias("caption"), F.col("m.note").alias("note"))


QUERIES["h19_media"] = _h19
_NOTES = {
    "image": f"CASE WHEN coalesce({_attr('alt')}, '') <> '' THEN 'alternative text given' ELSE 'image without alternative text' END",
    "video": "'moving picture: captions and size to be checked'",
    "interactive": "'part that reacts to input'",
}
ORACLE["h19_media"] = " UNION ALL ".join(
    f"""SELECT page_id, '{k}' AS media_type, {f"{D.base('url')} || {_attr('src')}" if k == 'image' else f"coalesce({_attr('src')}, '')" if k == 'video' else "''"} AS src,
    {f"nullif({_attr('alt')}, '')" if k == 'image' else 'NULL'} AS alt, {f"nullif({_attr('title')}, '')" if k == 'image' else 'NULL'} AS caption, {_NOTES[k]} AS note
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{p}')) AS m FROM {AP})"""
    for k, p in _MEDIA_KINDS
)

_LANG = r"""CASE WHEN regexp_matches(cls, '(?:lang-|language-)[a-zA-Z0-9]+') THEN lower(regexp_extract(cls, '(?:lang-|language-)([a-zA-Z0-9]+)', 1))
  WHEN contains(cls, 'php') THEN 'php' WHEN contains(cls, 'js') OR contains(cls, 'javascript') THEN 'javascript' WHEN contains(cls, 'css') THEN 'css' WHEN contains(cls, 'html') THEN 'html'
  WHEN contains(code, '<?php') OR contains(code, '->') THEN 'php' WHEN contains(code, 'function') OR contains(code, 'const ') OR contains(code, '=>') THEN 'javascript'
  WHEN contains(code, '{') AND contains(code, ':') AND contains(code, ';') THEN 'css' WHEN contains(code, '<') AND contains(code, '>') THEN 'html' ELSE 'text' END"""


def _h20(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", F.explode(H.code_snippets("html")).alias("s"))
    return p.select("page_id", "s.line_number", "s.language", "s.code", "s.has_version_info")


QUERIES["h20_code_snippets"] = _h20
ORACLE["h20_code_snippets"] = rf"""SELECT page_id, line_number, {_LANG} AS language, left({D.trim('code')}, 1000) AS code,
  regexp_matches(code, '{H.VERSION_INFO}') AS has_version_info
  FROM (SELECT page_id, i AS line_number, coalesce(regexp_extract(m, '(?is)^<code[^>]*\sclass={Q2}({NQ2}*){Q2}', 1), '') AS cls, {_entities(strip('m'))} AS code
    FROM (SELECT page_id, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<code(?:\s[^>]*)?>.*?</code>') AS a FROM {AP})))
  WHERE length({D.trim('code')}) >= 10"""

_CE = ("&lt;", "&gt;", "&amp;", "&quot;", "&#39;")
_CLEAN = D.trim(strip(_entities("m", _CE)))
_LIKELY = "(length(s) > 40 OR contains(s, '{') OR contains(s, '=>') OR contains(s, ';') OR contains(s, 'import ') OR contains(s, 'const '))"
_post(
    "h20_post_snippets",
    rf"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>', 1), lambda m: {D.trim(_entities(strip('m'), _CE))}),
      lambda s: length(s) > 20 AND length(s) < 1000)[1:5], '|') AS fenced,
    array_to_string({_DISTINCT.format(x='l')}, '|') AS likely FROM (SELECT doc_id, html, list_concat(
      list_filter(list_transform(regexp_extract_all(html, '(?is)<pre[^>]*><code[^>]*class={Q2}?language-\w+{Q2}?[^>]*>(.*?)</code></pre>', 1), lambda m: {_CLEAN}), lambda s: length(s) > 10),
      list_filter(list_transform(regexp_extract_all(html, '(?is)<code[^>]*>(.*?)</code>', 1), lambda m: {_CLEAN}), lambda s: {_LIKELY})) AS l FROM {POSTS})""",
    fenced=lambda: F.array_join(H.post_code_snippets("html"), "|"),
    likely=lambda: F.array_join(H.likely_code_snippets("html"), "|"),
)


def _h21(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", F.explode(H.code_snippets("html")).alias("s"))
    return p.select("page_id", F.col("s.line_number").alias("line_number"), H.is_simple_code("s.code").alias("simple"))


QUERIES["h21_is_simple_code"] = _h21
ORACLE["h21_is_simple_code"] = rf"""SELECT page_id, line_number, length(t) < 20 OR (contains(t, '{{') AND contains(t, ':') AND contains(t, ';') AND NOT contains(t, 'function'))
  OR (t LIKE '<%' AND t LIKE '%>' AND len(string_split(t, chr(10))) < 3) OR (contains(t, '=') AND NOT contains(t, 'function') AND NOT contains(t, 'class') AND len(string_split(t, chr(10))) < 5) AS simple
  FROM (SELECT page_id, line_number, {D.trim('code')} AS t FROM ({ORACLE['h20_code_snippets']}))"""

# tag selectors only, so the check can be written with regular expressions
_NOISE_TAGS = PG.NOISE_TAGS
_page(
    "h23_noise_reduction",
    f"""SELECT page_id, CAST(length(html) AS BIGINT) AS original_size, CAST(length(c) AS BIGINT) AS cleaned_size, {D.rnd('(1 - CAST(length(c) AS DOUBLE) / length(html)) * 100')} AS reduction_pct
    FROM (SELECT page_id, html, {drop('html', _NOISE_TAGS)} AS c FROM {AP})""",
    **{k: (lambda k=k: PG.noise_reduction("html")[k]) for k in ("original_size", "cleaned_size", "reduction_pct")},
)

_SHORTMD = "CASE doc_id % 5 WHEN 0 THEN substring(md, 1, 90) WHEN 1 THEN concat('  Loading ', md) ELSE md END"
_md(
    "h24_readable",
    f"""SELECT doc_id, reason IS NULL AS readable, reason FROM (SELECT doc_id, CASE WHEN length({D.trim('t')}) < 100 THEN 'insufficient-content'
    WHEN regexp_matches({D.trim('t')}, '^(?i)({'|'.join(K.LOADING_PREFIXES)})') THEN 'loading-state' END AS reason FROM (SELECT doc_id, {_SHORTMD} AS t FROM {MD}))""",
    readable=lambda: H.unreadable_reason(F.expr(_SHORTMD)).isNull(),
    reason=lambda: H.unreadable_reason(F.expr(_SHORTMD)),
)

_TTL = "CASE page_id % 10 WHEN 1 THEN 'The Hook list' WHEN 2 THEN 'FAQ' WHEN 5 THEN 'Release notes' WHEN 7 THEN 'Understanding it' ELSE 'Plain' END"
_KW = "CASE WHEN " + " OR ".join(f"contains(u, '{x}')" for x in K.NON_DOC_URL_PARTS) + " THEN 'non-documentation'"
for _k, _a, _t in K.KEYWORD_PAGE_TYPES:
    _KW += " WHEN " + " OR ".join([f"contains(u || ' ' || t, '{x}')" for x in _a] + [f"contains(t, '{x}')" for x in _t]) + f" THEN '{_k}'"
_KW += " END"
_ANSWER = "CASE page_id % 3 WHEN 0 THEN ' Tutorial ' WHEN 1 THEN 'no idea' ELSE 'Blog-Post' END"
_page(
    "h25_content_type",
    f"""SELECT page_id, k AS by_keyword, coalesce(k, CASE WHEN lower(trim(a)) IN ({D.q(K.MODEL_PAGE_TYPES)}) THEN lower(trim(a)) ELSE 'mixed' END) AS content_type
    FROM (SELECT page_id, {_KW} AS k, {_ANSWER} AS a FROM (SELECT page_id, lower(url) AS u, lower({_TTL}) AS t FROM {AP}))""",
    by_keyword=lambda: H.type_by_keyword("url", F.expr(_TTL)),
    content_type=lambda: F.coalesce(H.type_by_keyword("url", F.expr(_TTL)), H.model_page_type(F.expr(_ANSWER))),
)


def _m(x, p):
    return f"regexp_matches({x}, '(?i){p.replace(chr(39), chr(39) * 2)}')"


def _n(x, p):
    return D.nmatch(x, "(?i)" + p.replace("'", "''"))


_PRECNT, _CODECNT = _n("html", r"<pre[\s>]"), _n("html", r"<code[\s>]")
_FIRED = [(n, w, _m("lower(url)", p)) for n, w, p in K.DOC_URL_SIGNALS]
_FIRED += [
    (n, w, " AND ".join([_m("html", p), *[f"NOT {_m('html', q)}" for _, _, q in K.DOC_PLATFORM_SIGNALS[:k]]])) for k, (n, w, p) in enumerate(K.DOC_PLATFORM_SIGNALS)
]
_FIRED += [(n, w, _m("html", p)) for n, w, p in K.DOC_HTML_SIGNALS]
_FIRED += [(n, w, f"{_n('html', p)} >= {k}") for n, w, p, k in K.DOC_COUNT_SIGNALS]
_PROSE = rf"len(list_filter(regexp_extract_all(body, '(?is)<p[\s>].*?</p>'), lambda p: length({D.trim(strip('p'))}) > 80))"
_FIRED += [
    ("in-content anchors", 3, f"{_n('body', K.DOC_ANCHOR_PATTERN)} >= 5"),
    ("card listing", -3, f"({_n('html', K.DOC_CARD_GRID_PATTERN)} >= 2 OR {_n('html', K.DOC_CARD_PATTERN)} >= 6)"),
    ("image gallery", -2, f"({_n('html', r'<img[\s>]')} >= 10 AND {_n('html', r'<p[\s>]')} < 5)"),
    ("many buttons", -1, f"({_n('html', r'<button[\s>]')} >= 5 AND {_PRECNT} = 0)"),
    ("link hub", -3, f"({_n('body', K.DOC_OUTBOUND_PATTERN)} >= 8 AND {_PROSE} <= 2)"),
    ("no technical content", -1, f"NOT ({_PRECNT} > 0 OR {_CODECNT} >= 3 OR {_m('html', K.DOC_INSTALL_PATTERN)} OR {_m('html', K.DOC_API_WORDS_PATTERN)})"),
]
_SIGS = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {{'n': '{n}', 'w': {w}}} END" for n, w, cond in _FIRED) + "], lambda s: s IS NOT NULL)"
_BODY = drop("html", ["nav", "header", "footer", "aside"], "")
DOC_SQL = f"""(SELECT page_id, s, CASE WHEN regexp_replace({D.path('url')}, '/+$', '') = '' THEN 0 ELSE floor(100 / (1 + exp(-CAST(0.7 AS DOUBLE) * coalesce(list_sum(list_transform(s, lambda x: x.w)), 0))) + CAST(0.5 AS DOUBLE)) / 100 END AS doc_confidence
  FROM (SELECT page_id, url, {_SIGS} AS s FROM (SELECT page_id, url, html, {_BODY} AS body FROM {AP})))"""


def _h26(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select("page_id", "url", H.doc_signals("html", "url").alias("s"))
    p = p.withColumn("doc_confidence", H.doc_confidence(F.col("s"), "url"))
    review = PG.page_type_review(F.col("doc_confidence"), F.col("page_id") % 4 == 1)
    return p.select("page_id", F.array_join(F.col("s.name"), "|").alias("signals"), "doc_confidence", *[v.alias(k) for k, v in review.items()])


QUERIES["h26_doc_confidence"] = _h26
ORACLE["h26_doc_confidence"] = f"""SELECT page_id, array_to_string(list_transform(s, lambda x: x.n), '|') AS signals, doc_confidence, doc_confidence >= 0.4 AS is_doc,
  doc_confidence >= 0.4 AND doc_confidence < 0.95 AS needs_review,
  CASE WHEN doc_confidence >= 0.4 AND doc_confidence < 0.95 AND page_id % 4 = 1 THEN least(doc_confidence, CAST(0.3 AS DOUBLE)) ELSE doc_confidence END AS reviewed_confidence FROM {DOC_SQL}"""


def _h27(spark, sf):
    return spark_table(spark, sf, "markdown_docs").select(
        "doc_id", *[(F.round(v, 6) if k == "structure_ratio" else v).alias(k) for k, v in T.structural_signals("md", "title", "url").items()]
    )


QUERIES["h27_structural_signals"] = _h27
_WC = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
SIGNALS_SQL = rf"""(SELECT doc_id, CAST(len(lv) AS BIGINT) AS heading_count, CAST(coalesce(list_max(lv), 0) AS BIGINT) AS max_heading_depth,
  NOT list_contains(list_transform(range(2, len(u) + 1), lambda i: u[i] - u[i - 1] > 1), true) AS heading_levels_valid,
  CAST(len(sw) AS BIGINT) AS section_count, CASE WHEN len(sw) > 0 THEN {D.rnd('CAST(list_sum(sw) AS DOUBLE) / len(sw)')} ELSE 0 END AS avg_section_words, CAST(coalesce(list_max(sw), 0) AS BIGINT) AS max_section_words,
  CAST(len(pa) AS BIGINT) AS paragraph_count, items AS list_item_count, tables AS table_count,
  round(CASE WHEN len(pa) + items + tables > 0 THEN CAST(items + tables AS DOUBLE) / (len(pa) + items + tables) ELSE 0 END, 6) AS structure_ratio,
  CAST(floor({D.nmatch('md', '```')} / 2) AS BIGINT) AS code_block_count, {D.nmatch('md', r'```\w+')} AS tagged_code_blocks,
  CAST(len(list_filter(li, lambda x: x LIKE '#%' OR x LIKE '/%' OR contains(x, 'docs.example.com'))) AS BIGINT) AS internal_links,
  CAST(len(list_filter(li, lambda x: NOT (x LIKE '#%' OR x LIKE '/%' OR contains(x, 'docs.example.com')) AND x LIKE 'http%')) AS BIGINT) AS external_links,
  coalesce(regexp_matches(lower(hd[1]), 'summary|overview|tl;?dr|introduction|at a glance|quick start'), false) AS has_tldr,
  len(list_filter(string_split_regex(lower(title), '\s+'), lambda w: length(w) > 3 AND contains(lower(coalesce(pa[1], '')), w))) > 0 AS front_loaded,
  CASE WHEN len(pw) > 0 THEN {D.rnd('CAST(list_sum(pw) AS DOUBLE) / len(pw)')} ELSE 0 END AS avg_paragraph_words, CAST(len(list_filter(pw, lambda n: n > 150)) AS BIGINT) AS long_paragraphs,
  {D.nmatch('md', r'\*\*[^*]+\*\*\s*[:–—]')} AS defined_terms, CAST({_WC('md')} AS BIGINT) AS total_words
  FROM (SELECT *, list_sort(list_distinct(lv)) AS u, list_transform(pa, lambda p: {_WC('p')}) AS pw,
    CASE WHEN trows > 0 THEN CAST(greatest(1, floor(trows / 3)) AS BIGINT) ELSE 0 END AS tables FROM (
  SELECT doc_id, title, md, list_transform(regexp_extract_all(md, '(?m)^(#{{1,6}})\s+[^\n]+$', 1), lambda h: length(h)) AS lv, regexp_extract_all(md, '(?m)^#{{1,6}}\s+([^\n]+)$', 1) AS hd,
   list_transform(list_filter(string_split_regex(md, '(?m)^#{{1,6}}\s+'), lambda s: {D.trim('s')} <> ''), lambda s: {_WC('s')}) AS sw,
   list_filter(list_transform(string_split_regex(nc, '\n\s*\n'), lambda p: {D.trim('p')}), lambda p: p <> '' AND p NOT LIKE '#%' AND p NOT LIKE '|%' AND NOT regexp_matches(p, '^[-*+]\s|^\d+\.\s')) AS pa,
   {D.nmatch('nc', r'(?m)^\s*[-*+]\s|^\s*\d+\.\s')} AS items, {D.nmatch('nc', r'(?m)^\|[^\n]+\|$')} AS trows, regexp_extract_all(md, '\[[^\]]*\]\(([^)]+)\)', 1) AS li
  FROM (SELECT doc_id, title, md, regexp_replace(md, '(?s)```.*?```', '', 'g') AS nc FROM {MD}))))"""
ORACLE["h27_structural_signals"] = f"SELECT * FROM {SIGNALS_SQL}"

_ERRS = "list_concat(" + ", ".join(f"regexp_extract_all(t, '(?i){p}', 1)" for p in H.ERROR_PATTERNS) + ")"
_post(
    "h28_post_fields",
    rf"""SELECT doc_id, array_to_string(({_DISTINCT.format(x='e')})[1:3], '|') AS errors, array_to_string(tags, ',') AS tags,
    CASE WHEN len(fr) > 2 THEN array_to_string(fr[1:5], chr(10)) END AS stack_trace, array_to_string(rp[1:3], ' ') AS related, array_to_string(pb[1:3], '|') AS bodies
    FROM (SELECT doc_id, list_transform({_ERRS}, lambda x: {D.trim('x')}) AS e, list_transform(regexp_extract_all(html, '(?i)<a[^>]*class="[^"]*post-tag[^"]*"[^>]*>([^<]+)</a>', 1), lambda x: {D.trim('x')}) AS tags,
      regexp_extract_all(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '(?i)at\s+[\w.$]+\s*\([^)]+\)') AS fr, regexp_extract_all(html, '/docs/[^\s)]+') AS rp,
      regexp_extract_all(html, '(?is)<div class="s-prose js-post-body"[^>]*itemprop="text">(.*?)</div>\s*</div>', 1) AS pb FROM (SELECT doc_id, html, {strip('html', ' ')} AS t FROM {POSTS}))""",
    errors=lambda: F.array_join(H.error_messages("html"), "|"),
    tags=lambda: F.array_join(H.post_tags("html"), ","),
    stack_trace=lambda: H.stack_trace("html"),
    related=lambda: F.array_join(H.related_pages("html"), " "),
    bodies=lambda: F.array_join(H.post_bodies("html"), "|"),
)


def _h29(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select(
        "page_id", H.word_count(H.visible_text("html")).alias("words"), H.heading_count(H.headings("html")["level"], 2).alias("h2")
    )
    return p.select("page_id", "words", "h2", *[v.alias(k) for k, v in PG.chunking_flags(F.col("words"), F.col("h2")).items()])


QUERIES["h29_chunking_flags"] = _h29
ORACLE["h29_chunking_flags"] = f"""SELECT page_id, words, h2, words > 1500 AND h2 < 3 AS unchunked, NOT (words > 1500 AND h2 < 3) AND h2 > 0 AND floor(words / h2 + 0.5) > 500 AS long_sections,
  words > 0 AND words < 100 AS very_short, words >= 100 AND words < 500 AS short, h2 > 8 AND words < 600 AS thin_sections
  FROM (SELECT page_id, CAST({WORDS} AS BIGINT) AS words, {_level(2)} AS h2 FROM (SELECT page_id, {WORDS_TEXT} AS t, {HEADS} AS h FROM {AP}))"""

QUERIES["h22_main_text"] = lambda spark, sf: spark_table(spark, sf, "audit_pages").select("page_id", H.main_text("html").alias("main_text"))
_MAIN = r"coalesce(nullif(regexp_extract(html, '(?is)<main(?:\s[^>]*)?>(.*?)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1), ''), html)"
ORACLE["h22_main_text"] = f"""SELECT page_id, {D.squash(strip(drop("block", ["script", "style", "nav", "footer", "header"]), " "))} AS main_text FROM (SELECT page_id, {_MAIN} AS block FROM {oracle_table("audit_pages")})"""
