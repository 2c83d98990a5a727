"""Registered queries over links, context pages, scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions import urls as U
from doccensus.functions.common import bucketed, settled
from doccensus.operators import evidence as V
from doccensus.operators import links as L
from doccensus.operators import pages as PG
from doccensus.operators import probes as P
from doccensus.operators import robots as R
from doccensus.operators import scoring as G
from doccensus.plans import oracle_frag as D
from doccensus.plans import pages_queries as PQ
from doccensus.plans import sites_queries as SQ
from doccensus.plans.inputs import oracle_table, spark_table

QUERIES: dict = {}
ORACLE: dict = {}
AP, LOG, SROB, DIMS, FIND, KB = (
    oracle_table(x) for x in ("audit_pages", "fetch_log", "site_robots", "dimension_results", "findings", "kb_rows")
)

# ── links ───────────────────────────────────────────────────────────────

_ANCH = "(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
_DIR = f"regexp_extract({D.path('page_url')}, '^(.*/)', 1)"
_RESOLVE = f"""CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '//%' THEN {D.scheme('page_url')} || ':' || href WHEN href LIKE '/%' THEN {D.base('page_url')} || href
  WHEN href LIKE '?%' THEN {D.base('page_url')} || {D.path('page_url')} || href
  WHEN href LIKE '../up/./%' THEN {D.base('page_url')} || coalesce(nullif(regexp_extract({_DIR}, '^(.*/)[^/]+/$', 1), ''), '/') || 'up/' || substring(href, 9) ELSE {D.base('page_url')} || {_DIR} || href END"""
_GROUPS = ", ".join(f"('{n}', {i})" for i, g in enumerate(K.RELATED_DOMAIN_GROUPS) for n in g)
LINKS = f"""(WITH g(root, grp) AS (VALUES {_GROUPS}), r AS (SELECT page_id, page_url, pos, href, {D.trim(PQ.strip('inner_html'))} AS anchor_text, {_RESOLVE} AS url FROM (
    SELECT page_id, page_url, unnest(hs) AS href, unnest(ts) AS inner_html, generate_subscripts(hs, 1) - 1 AS pos FROM (
      SELECT page_id, url AS page_url, regexp_extract_all(html, '{_ANCH}', 1) AS hs, regexp_extract_all(html, '{_ANCH}', 2) AS ts FROM {AP}))
    WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
  h AS (SELECT *, {D.host('url')} AS lh, {D.host('page_url')} AS ph FROM r),
  k AS (SELECT *, lh <> '' AND (lh = ph OR {D.root2('lh')} = {D.root2('ph')} OR coalesce((SELECT grp FROM g WHERE root = {D.root2('lh')}) = (SELECT grp FROM g WHERE root = {D.root2('ph')}), false)) AS internal FROM h)
  SELECT page_id, page_url, lh, ph, CAST(pos AS BIGINT) AS pos, href, url, anchor_text, internal, internal AND {D.path('url')} <> {D.path('page_url')} AS other_page FROM k)"""


def _links(spark, sf):
    return L.page_links(spark_table(spark, sf, "audit_pages"))


QUERIES["h18_page_links"] = _links
ORACLE["h18_page_links"] = f"SELECT page_id, pos, href, url, anchor_text, internal, other_page FROM {LINKS}"

SUBS = f"""(SELECT p.page_id, coalesce(t, 0) AS total_links, coalesce(i, 0) AS internal_links, coalesce(t - i, 0) AS external_links, coalesce(s, []) AS sub_pages FROM {AP} p
  LEFT JOIN (SELECT page_id, count(*) AS t, count(*) FILTER (internal) AS i FROM {LINKS} GROUP BY page_id) a ON a.page_id = p.page_id
  LEFT JOIN (SELECT page_id, (list(anchor_text ORDER BY pos))[1:10] AS s FROM (SELECT page_id, anchor_text, min(pos) AS pos FROM {LINKS} WHERE other_page AND anchor_text <> '' GROUP BY ALL) GROUP BY page_id) b ON b.page_id = p.page_id)"""
QUERIES["h18_link_summary"] = lambda spark, sf: L.link_summary(spark_table(spark, sf, "audit_pages"), _links(spark, sf)).withColumn(
    "sub_pages", F.array_join("sub_pages", "|")
)
ORACLE["h18_link_summary"] = f"""SELECT page_id, total_links, internal_links, external_links, array_to_string(sub_pages, '|') AS sub_pages,
  CASE WHEN len(sub_pages) > 0 THEN 'multi-page-referenced' ELSE 'single-page' END AS link_context FROM {SUBS}"""

QUERIES["p7_unique_links"] = lambda spark, sf: P.unique_links(_links(spark, sf).filter("internal"))
ORACLE["p7_unique_links"] = f"SELECT page_id, url, min(pos) AS pos, arg_min(anchor_text, pos) AS anchor_text FROM {LINKS} WHERE internal GROUP BY page_id, url"

_SEGP = D.segs(D.path("url"))
_PPATH = f"'/' || array_to_string(({_SEGP})[1:len({_SEGP}) - 1], '/') || '/'"
_NAVS = "array_to_string(regexp_extract_all(html, '(?is)<nav[^>]*>.*?</nav>'), '')"
CONTEXT = f"""(WITH pr AS (SELECT page_id, 0 AS ord, {D.scheme('url')} || '://' || {D.host('url')} || pp AS url, coalesce(nullif(
      {D.trim(PQ.strip("(list_filter(list_transform(range(1, len(hs) + 1), lambda i: {'h': hs[i], 't': ts[i]}), lambda x: contains(x.h, pp))[-1]).t"))}, ''), 'Parent Documentation') AS title
    FROM (SELECT page_id, url, {_PPATH} AS pp, regexp_extract_all({_NAVS}, '{_ANCH}', 1) AS hs, regexp_extract_all({_NAVS}, '{_ANCH}', 2) AS ts FROM {AP} WHERE len({_SEGP}) > 1)),
  ch AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ord, url, title FROM (SELECT page_id, url, min(pos) AS pos, arg_min(anchor_text, pos) AS title FROM {LINKS}
    WHERE anchor_text <> '' AND lh = ph AND starts_with({D.path('url')}, {D.path('page_url')}) AND {D.path('url')} <> {D.path('page_url')} AND length({D.path('url')}) < 200 GROUP BY page_id, url)),
  b AS (SELECT *, 'parent' AS relationship, CAST(0.8 AS DOUBLE) AS confidence FROM pr UNION ALL SELECT *, 'child', CAST(0.7 AS DOUBLE) FROM ch WHERE ord <= 3)
  SELECT page_id, CAST(ord AS BIGINT) AS ord, url, title, relationship, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS n FROM b) WHERE n = 1)"""


def _kb(spark, sf):
    return spark_table(spark, sf, "kb_rows").drop("page_id").withColumn("domain", U.kb_domain("url"))


QUERIES["h31_context_pages"] = lambda spark, sf: L.context_pages(spark_table(spark, sf, "audit_pages"), _kb(spark, sf)).drop("key_terms", "covers")
ORACLE["h31_context_pages"] = f"SELECT c.page_id, ord, c.url, c.title, relationship, confidence, documentation_type, topic FROM {CONTEXT} c LEFT JOIN {KB} k ON k.url = c.url"

_PICKS = "concat('[', CAST(page_id % 5 AS STRING), ', 2, 0, 900000, 1, 4, 7]')"


def _selected(spark, sf):
    pages, kb = spark_table(spark, sf, "audit_pages"), _kb(spark, sf)
    answers = pages.filter("page_id % 3 <> 0").select("page_id", F.expr(_PICKS).alias("text"))
    return pages, L.add_selected_context(pages, L.context_pages(pages, kb), kb, answers)


QUERIES["h32_selected_context"] = lambda spark, sf: _selected(spark, sf)[1].drop("key_terms", "covers")
SELECTED = f"""(WITH kbd AS (SELECT *, replace({D.root2(D.nowww(D.host('url')))}, '.', '-') AS domain FROM {KB}), pg AS (SELECT page_id, url, replace({D.root2(D.nowww(D.host('url')))}, '.', '-') AS domain FROM {AP}),
  ctx AS (SELECT c.page_id, ord, c.url, c.title, relationship, confidence, documentation_type, topic FROM {CONTEXT} c LEFT JOIN {KB} k ON k.url = c.url),
  cat AS (SELECT pg.page_id, row_number() OVER (PARTITION BY pg.page_id ORDER BY md5(k.url), k.url) - 1 AS idx, k.url, k.title, k.documentation_type, k.topic FROM pg JOIN kbd k ON k.domain = pg.domain
    WHERE k.url <> pg.url AND NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.page_id = pg.page_id AND ctx.url = k.url)),
  pk AS (SELECT page_id, unnest([page_id % 5, 2, 0, 900000, 1, 4, 7]) AS idx, unnest([0, 1, 2, 3, 4, 5, 6]) AS o FROM pg WHERE page_id % 3 <> 0),
  sel AS (SELECT cat.*, row_number() OVER (PARTITION BY cat.page_id ORDER BY o) AS pick FROM pk JOIN cat ON cat.page_id = pk.page_id AND cat.idx = pk.idx),
  al AS (SELECT * FROM ctx UNION ALL SELECT page_id, CAST(3 + pick AS BIGINT), url, coalesce(title, url), 'sibling', CAST(0.6 AS DOUBLE), documentation_type, topic FROM sel WHERE pick <= 4),
  op AS (SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM al WHERE topic IS NULL)
  SELECT al.*, coalesce(op.n <= 3, false) AS to_fetch FROM al LEFT JOIN op ON op.page_id = al.page_id AND op.ord = al.ord)"""
ORACLE["h32_selected_context"] = f"SELECT * FROM {SELECTED}"
QUERIES["h32_context_scope"] = lambda spark, sf: L.context_scope(*_selected(spark, sf))
ORACLE["h32_context_scope"] = f"""SELECT p.page_id, CASE WHEN count(s.url) > 0 THEN 'with-context' ELSE 'single-page' END AS scope, count(s.url) + 1 AS total_pages, count(s.topic) AS enriched
  FROM {AP} p LEFT JOIN {SELECTED} s ON s.page_id = p.page_id GROUP BY p.page_id"""

# ── readiness ───────────────────────────────────────────────────────────

_SEG = D.segs(D.path("url"))
_OKURL = f"(SELECT DISTINCT url FROM {LOG} WHERE status_code BETWEEN 200 AND 299)"
_SUBP = f"CASE WHEN len({_SEG}) >= 2 AND lower(({_SEG})[1]) IN ({D.q(K.DOCS_PATH_SEGMENTS)}) THEN '/' || ({_SEG})[1] END"
FLAGS = f"""(SELECT page_id, b || '/llms.txt' IN (SELECT url FROM {_OKURL}) OR coalesce(b || sub || '/llms.txt' IN (SELECT url FROM {_OKURL}), false) AS llms_found,
  b || '/llms-full.txt' IN (SELECT url FROM {_OKURL}) OR coalesce(b || sub || '/llms-full.txt' IN (SELECT url FROM {_OKURL}), false) AS llms_full_found,
  coalesce(nullif({D.trim(f"regexp_extract(body, '(?im)^Sitemap:\\s*([^{chr(92)}n]+)$', 1)")}, ''), b || '/sitemap.xml') IN (SELECT url FROM {_OKURL}) AS sitemap_found
  FROM (SELECT page_id, {D.base('url')} AS b, {_SUBP} AS sub FROM {AP}) LEFT JOIN {SROB} r ON r.base_url = b)"""
_ALT2 = "coalesce(" + ", ".join(PQ.ext("html", p.replace('\\"', '"').replace("'", "''")) for p in H.MD_ALTERNATES[:2]) + ")"
_SJ = lambda x: f"CASE WHEN {x} LIKE 'http%' THEN {x} WHEN {x} LIKE '/%' THEN {D.base('url')} || {x} ELSE {D.base('url')} || '/' || {x} END"
MARKDOWN = f"""(SELECT m.page_id, len(urls) > 0 AS markdown_found, urls AS markdown_urls, named IS NOT NULL OR llms_found AS markdown_discoverable,
    CASE WHEN len(urls) > 0 THEN coalesce(named, CASE WHEN llms_found THEN 'llms-txt' END, 'none') END AS markdown_method FROM (
  SELECT page_id, CASE WHEN len(known) > 0 THEN list_filter(known, lambda y, j: list_position(known, y) = j) WHEN regexp_replace(url, '/$', '') || '.md' IN (SELECT url FROM {_OKURL}) THEN [regexp_replace(url, '/$', '') || '.md'] ELSE [] END AS urls,
    CASE WHEN lk IS NOT NULL THEN 'link-header' WHEN alt IS NOT NULL THEN 'link-alternate' END AS named FROM (
   SELECT page_id, url, alt, lk, list_concat(CASE WHEN alt IS NOT NULL THEN [{_SJ('alt')}] ELSE [] END, CASE WHEN lk IS NOT NULL THEN [lk] ELSE [] END,
     list_transform(regexp_extract_all(html, '(?i)href=["'']([^"'']*\\.md)["'']', 1)[1:3], lambda x: {_SJ('x')})) AS known FROM (
    SELECT page_id, url, html, {_ALT2} AS alt, {PQ.ext('link', '(?i)<([^>]+)>;\\s*rel="alternate";\\s*type="text/markdown"')} AS lk FROM {SQ.HEADERS}))) m JOIN {FLAGS} f ON f.page_id = m.page_id)"""


def _h17(spark, sf):
    pages, log = SQ.headed_pages(spark, sf), spark_table(spark, sf, "fetch_log")
    flags = PG.site_file_flags(pages, log, spark_table(spark, sf, "site_robots"))
    return PG.markdown_availability(pages, log, flags.select("page_id", "llms_found")).withColumn(
        "markdown_urls", F.array_join("markdown_urls", " ")
    )


QUERIES["h17_markdown_availability"] = _h17
ORACLE["h17_markdown_availability"] = f"SELECT page_id, markdown_found, array_to_string(markdown_urls, ' ') AS markdown_urls, markdown_discoverable, markdown_method FROM {MARKDOWN}"


def features(spark, sf, answers=None):
    return PG.readiness_features(SQ.headed_pages(spark, sf), spark_table(spark, sf, "fetch_log"), spark_table(spark, sf, "site_robots"), answers=answers)


def _features_and_signals(spark, sf):
    """Both reports on one table of answers, stored by URL."""
    answers = bucketed(P.answers_by_url(spark_table(spark, sf, "fetch_log")), "url")
    return features(spark, sf, answers), V.evidence_signals(*SQ.evidence_inputs(spark, sf), answers=answers)


_V1 = SQ.ORACLE["r3_bot_status_v1"].replace(SQ.ROB, f"(SELECT base_url AS domain, body FROM {SROB})")
FEATURES = f"""(WITH v1 AS (SELECT domain, count(*) FILTER (status = 'blocked') AS bots_blocked, count(*) FILTER (status = 'not-mentioned') AS bots_unlisted FROM ({_V1}) GROUP BY domain)
SELECT x.page_id, x.url, x.html, x.words, x.h, {PQ._level(1)} AS h1_count, {PQ._level(2)} AS h2_count, {PQ.NESTED} AS proper_nesting, least(len(h), 20) AS heading_count, js_rendered, ratio,
  CASE WHEN ratio < 0.15 THEN 'very-low' WHEN ratio < 0.30 THEN 'low' ELSE 'good' END AS ratio_status, page_type, has_canonical, blocks_indexing, has_breadcrumbs, code_blocks, code_hints, code_blocks > 0 AS has_code,
  l.n AS internal_links, l.density_status, o.og_status, o.missing_tags, s.has_jsonld, s.types, s.fields, len(list_intersect(types, {D.lst(K.SCHEMA_TYPES)})) > 0 AS valid_schema, {PQ.SCHEMA_STATUS} AS schema_status, {PQ.MISSING_F} AS missing_fields,
  f.llms_found, f.llms_full_found, f.sitemap_found, m.markdown_found, m.markdown_discoverable, coalesce(rb.body, '') <> '' AS has_robots, v1.bots_blocked, v1.bots_unlisted
FROM (SELECT page_id, url, html, CAST({PQ.WORDS} AS BIGINT) AS words, {PQ.HEADS} AS h, {PQ.JS} AS js_rendered, CAST(strlen({PQ.RATIO_TEXT}) AS DOUBLE) / strlen(html) AS ratio, {PQ.PAGE_TYPE} AS page_type,
    {PQ._CF} IS NOT NULL AS has_canonical, {PQ.NOINDEX} AS blocks_indexing, {PQ.CRUMBS} AS has_breadcrumbs, {PQ.PRE} AS code_blocks, CASE WHEN {PQ.PRE} > 0 THEN {PQ.HINT} ELSE 0 END AS code_hints
    FROM (SELECT *, {PQ.WORDS_TEXT} AS t FROM {AP})) x
 JOIN {PQ.LINKS_SQL} l ON l.page_id = x.page_id JOIN {PQ.OG_SCORE} o ON o.page_id = x.page_id JOIN {PQ.SCHEMA_ROWS} s ON s.page_id = x.page_id
 JOIN {FLAGS} f ON f.page_id = x.page_id JOIN {MARKDOWN} m ON m.page_id = x.page_id LEFT JOIN {SROB} rb ON rb.base_url = {D.base('x.url')} LEFT JOIN v1 ON v1.domain = {D.base('x.url')})"""
_IF = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
SCORES = f"""(SELECT *, discoverability + consumability + structured AS overall FROM (SELECT *, CAST(least(40, {_IF('llms_found', 15)} + {_IF('sitemap_found', 8)} + {_IF('has_canonical', 5)} - {_IF('blocks_indexing', 5)}
   + CASE WHEN markdown_found AND markdown_discoverable THEN 12 WHEN markdown_found THEN 8 ELSE 0 END) AS BIGINT) AS discoverability,
  CAST(least(40, CASE WHEN h1_count = 1 THEN 12 WHEN h1_count > 0 THEN 4 ELSE 0 END + {_IF('proper_nesting', 8)} + {_IF('NOT js_rendered', 10)} + CASE WHEN words BETWEEN 500 AND 2000 THEN 6 WHEN words >= 300 THEN 3 ELSE 0 END + {_IF("density_status = 'good'", 4)}) AS BIGINT) AS consumability,
  CAST(least(20, CASE WHEN has_jsonld AND valid_schema THEN 5 WHEN has_jsonld THEN 3 ELSE 0 END + CASE schema_status WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END + CASE og_status WHEN 'complete' THEN 10 WHEN 'partial' THEN 6 ELSE 0 END + {_IF('has_breadcrumbs', 3)}) AS BIGINT) AS structured FROM {FEATURES}))"""
GRADE = "CASE " + " ".join(f"WHEN overall >= {s} THEN '{g}'" for g, s in K.GRADES) + " ELSE 'F' END"

QUERIES["g1_readiness_scores"] = lambda spark, sf: G.readiness_scores(features(spark, sf)).select("page_id", "discoverability", "consumability", "structured")
ORACLE["g1_readiness_scores"] = f"SELECT page_id, discoverability, consumability, structured FROM {SCORES}"
QUERIES["g2_overall_and_grade"] = lambda spark, sf: G.readiness_scores(features(spark, sf)).select("page_id", "overall", G.grade(F.col("overall")).alias("grade"))
ORACLE["g2_overall_and_grade"] = f"SELECT page_id, overall, {GRADE} AS grade FROM {SCORES}"

QUERIES["audit_site_grades"] = lambda spark, sf: (
    G.readiness_scores(features(spark, sf)).withColumn("kb_domain", U.kb_domain("url")).withColumn("grade", G.grade(F.col("overall")))
    .groupBy("kb_domain", "grade").agg(F.count("*").alias("pages"), F.round(F.avg("overall"), 6).alias("mean_overall"), F.sum("words").alias("words"))
)
ORACLE["audit_site_grades"] = f"""SELECT replace({D.root2(D.nowww(D.host('url')))}, '.', '-') AS kb_domain, {GRADE} AS grade, count(*) AS pages, round(avg(overall), 6) AS mean_overall, CAST(sum(words) AS BIGINT) AS words
  FROM {SCORES} GROUP BY ALL"""

_PCT = "format('{:.1f}', ratio * 100)"
_AVG = "CASE WHEN h2_count > 0 THEN CAST(floor(CAST(words AS DOUBLE) / h2_count + 0.5) AS BIGINT) ELSE words END"
_MP = lambda a, b: f"CASE WHEN markdown_found THEN '{a}' ELSE '{b}' END"
_RULES = [
    ("robots-missing", "Bot Access", "'medium'", "NOT has_robots", "NULL"),
    ("bots-blocked", "Bot Access", "'high'", "has_robots AND bots_blocked > 0", "bots_blocked"),
    ("bots-unlisted", "Bot Access", "'low'", "has_robots AND bots_unlisted > 0 AND bots_unlisted < 10", "bots_unlisted"),
    ("llms-missing", "Discoverability", "'high'", "NOT llms_found", "NULL"),
    ("sitemap-missing", "Discoverability", "'medium'", "NOT sitemap_found", "NULL"),
    ("canonical-missing", "Discoverability", "'low'", "NOT has_canonical", "NULL"),
    ("noindex", "Discoverability", "'high'", "blocks_indexing", "NULL"),
    ("js-rendered", "Consumability", "'high'", "js_rendered", "NULL"),
    ("h1-missing", "Consumability", "'medium'", "h1_count = 0", "NULL"),
    ("h1-repeated", "Consumability", "'low'", "h1_count > 1", "h1_count"),
    ("heading-skips", "Consumability", "'low'", "NOT proper_nesting AND heading_count > 2", "NULL"),
    ("markdown-missing", "Consumability", "'medium'", "NOT markdown_found", "NULL"),
    ("markdown-hidden", "Discoverability", "'best-practice'", "markdown_found AND NOT markdown_discoverable", "NULL"),
    ("ratio-very-low", "Consumability", _MP("low", "high"), "ratio_status = 'very-low'", _PCT),
    ("ratio-low", "Consumability", "'medium'", "ratio_status = 'low' AND NOT markdown_found", _PCT),
    ("code-unlabelled", "Consumability", _MP("low", "medium"), "has_code AND code_hints = 0", "code_blocks"),
    ("few-links", "Consumability", "'low'", "density_status = 'sparse' AND internal_links < 3", "NULL"),
    ("unchunked", "Consumability", "'high'", "words > 1500 AND h2_count < 3", "format('{:,}', words) || '/' || h2_count"),
    ("long-sections", "Consumability", "'medium'", f"NOT (words > 1500 AND h2_count < 3) AND h2_count > 0 AND {_AVG} > 500", _AVG),
    ("very-short", "Consumability", "'medium'", "words > 0 AND words < 100", "words"),
    ("short", "Consumability", "'low'", "words >= 100 AND words < 500", "words"),
    ("thin-sections", "Consumability", "'low'", "h2_count > 8 AND words < 600", "h2_count || '/' || words"),
    ("api-without-code", "Consumability", "'high'", "page_type = 'api-reference' AND NOT has_code", "NULL"),
    ("jsonld-missing", "Structured Data", "'low'", "len(types) = 0", "NULL"),
    ("jsonld-generic", "Structured Data", "'low'", "len(types) > 0 AND NOT valid_schema", "array_to_string(types, ', ')"),
    ("schema-partial", "Structured Data", "'low'", "schema_status = 'partial'", "array_to_string(missing_fields, ', ')"),
    ("og-partial", "Structured Data", "'low'", "og_status = 'partial'", "replace(missing_tags, ',', ', ')"),
    ("og-missing", "Structured Data", "'medium'", "og_status = 'missing'", "NULL"),
    ("breadcrumbs-missing", "Structured Data", "'low'", "NOT has_breadcrumbs", "NULL"),
]
_SNIP = {"robots-missing", "bots-blocked", "bots-unlisted", "llms-missing", "sitemap-missing", "canonical-missing", "markdown-missing", "markdown-hidden", "code-unlabelled", "jsonld-missing", "og-partial", "og-missing", "breadcrumbs-missing"}
RECS = "(WITH f AS MATERIALIZED (SELECT * FROM " + FEATURES + ") " + " UNION ALL ".join(
    f"SELECT page_id, CAST({i} AS BIGINT) AS ord, '{r}' AS rule, '{c}' AS category, {p} AS priority, CAST({a} AS VARCHAR) AS args, {str(r in _SNIP).lower()} AS has_snippet FROM f WHERE {w}"
    for i, (r, c, p, w, a) in enumerate(_RULES)
) + ")"

QUERIES["g4_recommendations"] = lambda spark, sf: G.recommendation_rules(features(spark, sf)).select("page_id", "ord", "rule", "category", "priority", "args")
ORACLE["g4_recommendations"] = f"SELECT page_id, ord, rule, category, priority, args FROM {RECS}"

_TIERS = "CASE page_id % 5 WHEN 0 THEN 'not-found' WHEN 1 THEN 'low' WHEN 2 THEN 'partial' ELSE 'high' END"


def _merged(spark, sf):
    f, signals = _features_and_signals(spark, sf)
    tiers = spark_table(spark, sf, "audit_pages").select("page_id", F.expr(_TIERS).alias("citation_tier"))
    return G.merge_recommendations(G.recommendation_rules(f), G.citation_recommendations(tiers), G.detection_notes(signals))


QUERIES["g5_merge_recommendations"] = lambda spark, sf: _merged(spark, sf).select("page_id", "position", "rule", "category", "priority", "args")
MERGED = f"""(WITH notes AS (SELECT page_id, signal, status, note, CASE WHEN signal = 'llms.txt' AND status = 'verified' AND note IS NOT NULL THEN '0link-header-mismatch' WHEN signal = 'llms.txt' AND status = 'advertised' THEN '1llms-advertised'
    WHEN signal = 'llms-full.txt' AND status = 'advertised' AND note IS NOT NULL THEN '2llms-full-advertised' WHEN signal = 'markdown' AND status = 'advertised' AND note IS NOT NULL THEN '3markdown-advertised'
    WHEN signal = 'AGENTS.md' AND validated_url IS NOT NULL THEN '4agents-file' WHEN signal = 'mcp.json' AND validated_url IS NOT NULL THEN '5mcp-config' END AS r FROM {SQ.EVIDENCE}),
  u AS (SELECT page_id, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS k, 0 AS src, ord, rule, category, priority, args, has_snippet FROM {RECS}
    UNION ALL SELECT page_id, CASE t WHEN 'partial' THEN 1 ELSE 0 END, 1, 0, 'citations-' || t, 'AI Discoverability', CASE t WHEN 'partial' THEN 'medium' ELSE 'high' END, NULL, false FROM (SELECT page_id, {_TIERS} AS t FROM {AP}) WHERE t <> 'high'
    UNION ALL SELECT page_id, 9, 2, CAST(left(r, 1) AS INTEGER), substring(r, 2), 'Discoverability', 'best-practice', note, false FROM notes WHERE r IS NOT NULL)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, src, ord) AS position, rule, category, priority, args, has_snippet FROM u)"""
ORACLE["g5_merge_recommendations"] = f"SELECT page_id, position, rule, category, priority, args FROM {MERGED}"

QUERIES["g6_recommendation_buckets"] = lambda spark, sf: G.recommendation_buckets(_merged(spark, sf))
ORACLE["g6_recommendation_buckets"] = f"""SELECT page_id, position, rule, CASE WHEN priority = 'high' THEN 'Quick Wins' WHEN priority <> 'best-practice' THEN 'Deeper Improvements' ELSE 'Things to Watch' END AS bucket,
  priority <> 'best-practice' AND row_number() OVER (PARTITION BY page_id ORDER BY priority = 'best-practice', priority <> 'high', position) <= 3 AS is_top,
  CASE priority WHEN 'high' THEN 'High impact' WHEN 'medium' THEN 'Medium impact' ELSE 'Low impact' END AS impact, CASE WHEN has_snippet THEN 'Medium effort' ELSE 'Low effort' END AS effort FROM {MERGED}"""


def _g7(spark, sf):
    f = settled(features(spark, sf))
    n = G.recommendation_rules(f).groupBy("page_id").agg(F.count("*").alias("n"))
    scored = G.readiness_scores(f).select("page_id", "overall").join(n, "page_id", "left")
    label = G.grade_label(F.col("overall"), F.coalesce("n", F.lit(0)))
    return G.health_counter(f).join(scored, "page_id").select("page_id", "passed", "total", label.alias("label"))


QUERIES["g7_health_counter"] = _g7
_CHECKS = [
    "llms_found", "llms_full_found", "sitemap_found", "has_canonical", "NOT blocks_indexing", "ratio_status = 'good'", "NOT js_rendered", "h1_count = 1", "markdown_found",
    "(NOT has_code OR code_hints > 0)", "density_status = 'good'", "has_jsonld", "schema_status <> 'missing'", "og_status <> 'missing'", "has_breadcrumbs",
]
_LABEL = "CASE WHEN coalesce(n, 0) = 0 THEN 'clean' ELSE CASE WHEN overall >= 90 THEN 'very good' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'middling' ELSE 'poor' END || ', open points: ' || n END"
ORACLE["g7_health_counter"] = f"""SELECT s.page_id, CAST({' + '.join(_IF(x, 1) for x in _CHECKS)} AS BIGINT) AS passed, CAST(15 AS BIGINT) AS total,
  {_LABEL} AS label
  FROM {SCORES} s LEFT JOIN (SELECT page_id, count(*) AS n FROM {RECS} GROUP BY page_id) r ON r.page_id = s.page_id"""

# ── dimensions ──────────────────────────────────────────────────────────

_W = ", ".join(f"('{t}', '{d}', {w})" for t, ws in K.CONTENT_TYPE_WEIGHTS.items() for d, w in zip(K.DIMENSIONS, ws))
WEIGHTED = f"""(SELECT page, dimension, content_type, score, status, CASE WHEN score IS NOT NULL THEN CAST(w AS DOUBLE) END AS weight FROM {DIMS} d
  LEFT JOIN (VALUES {_W}) v(t, dim, w) ON v.dim = d.dimension AND v.t = CASE WHEN content_type IN ({D.q(K.CONTENT_TYPE_WEIGHTS)}) THEN content_type ELSE 'mixed' END)"""


def _dims(spark, sf):
    return G.apply_weights(spark_table(spark, sf, "dimension_results"))


QUERIES["g8_apply_weights"] = _dims
ORACLE["g8_apply_weights"] = f"SELECT * FROM {WEIGHTED}"


def _penalties(spark, sf):
    """What a page's slug findings cost: the certain ones of its URL, each as often as reported, and the doubtful ones."""
    p = spark_table(spark, sf, "audit_pages")
    high = F.size(F.filter(U.slug_typo_hits("url"), lambda h: h["confidence"] == "HIGH"))
    # ids stand for how often the same slug was reported
    return p.select(F.col("page_id").alias("page"), G.slug_penalty(high * (F.col("page_id") % 8), F.col("page_id") % 3).cast("long").alias("penalty"))


def _g9(spark, sf):
    out = G.penalise_clarity(spark_table(spark, sf, "dimension_results"), _penalties(spark, sf))
    return out.filter("dimension = 'clarity'").select("page", "score")


QUERIES["g9_slug_penalty"] = _g9
_HIGH = "CASE WHEN page_id % 8 = 6 THEN 1 WHEN page_id % 8 = 7 THEN 1 ELSE 0 END"
ORACLE["g9_slug_penalty"] = f"""SELECT d.page, CASE WHEN score IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), score - CASE WHEN page_id IS NULL THEN 0 ELSE least(25, ({_HIGH}) * (page_id % 8) * 5 + (page_id % 3) * 3) END) END AS score
  FROM {DIMS} d LEFT JOIN {AP} p ON p.page_id = d.page WHERE dimension = 'clarity'"""

QUERIES["g10_weighted_overall"] = lambda spark, sf: G.weighted_overall(_dims(spark, sf))
ORACLE["g10_weighted_overall"] = f"""SELECT page, {D.rnd('list_reduce(list(score * weight ORDER BY d) FILTER (score IS NOT NULL), lambda a, b: a + b) / list_reduce(list(weight ORDER BY d) FILTER (score IS NOT NULL), lambda a, b: a + b)')} AS overall
  FROM (SELECT *, list_position({D.lst(K.DIMENSIONS)}, dimension) AS d FROM {WEIGHTED}) GROUP BY page"""
QUERIES["g11_simple_overall"] = lambda spark, sf: G.simple_overall(spark_table(spark, sf, "dimension_results"))
ORACLE["g11_simple_overall"] = f"""SELECT page, coalesce({D.rnd("avg(score) FILTER (status = 'complete')")}, 0) AS overall, count(score) FILTER (status = 'complete') AS dimensions_analyzed,
  CASE WHEN count(score) FILTER (status = 'complete') = 5 THEN 'high' WHEN count(score) FILTER (status = 'complete') >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM {DIMS} GROUP BY page"""
QUERIES["g12_key_findings"] = lambda spark, sf: G.key_findings(spark_table(spark, sf, "findings"))
ORACLE["g12_key_findings"] = f"""SELECT page, position, '[' || dimension || '] ' || finding AS finding FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY d, pos) AS position FROM (
  SELECT *, list_position({D.lst(K.DIMENSIONS)}, dimension) AS d, row_number() OVER (PARTITION BY page, dimension ORDER BY pos) AS n FROM {FIND} WHERE finding NOT LIKE 'Content type:%') WHERE n <= 2) WHERE position <= 10"""

# ── summaries ───────────────────────────────────────────────────────────

QUERIES["g13_code_summary"] = lambda spark, sf: G.code_summary(PQ.QUERIES["h20_code_snippets"](spark, sf)).withColumn("languages", F.array_join("languages", ","))
ORACLE["g13_code_summary"] = f"""SELECT page_id, count(*) AS snippets, count(*) FILTER (NOT has_version_info) AS missing_version, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages
  FROM ({PQ.ORACLE['h20_code_snippets']}) GROUP BY page_id"""
QUERIES["g13_media_summary"] = lambda spark, sf: G.media_summary(PQ.QUERIES["h19_media"](spark, sf))
ORACLE["g13_media_summary"] = f"""SELECT page_id, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (media_type = 'interactive') AS interactive,
  count(*) FILTER (contains(note, 'accessibility')) AS accessibility_issues, count(*) FILTER (media_type = 'image' AND alt IS NULL) AS missing_alt FROM ({PQ.ORACLE['h19_media']}) GROUP BY page_id"""


def _code_findings(spark, sf):
    s = PQ.QUERIES["h20_code_snippets"](spark, sf)
    kind = F.when(F.col("language") == "javascript", "deprecated").otherwise("syntax")
    return s.select("page_id", kind.alias("kind"), F.expr("CASE length(code) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("confidence"))


QUERIES["g13_finding_confidence"] = lambda spark, sf: G.finding_confidence(_code_findings(spark, sf))
ORACLE["g13_finding_confidence"] = f"""SELECT page_id, count(*) FILTER (language = 'javascript') AS deprecated, count(*) FILTER (language <> 'javascript') AS syntax_errors,
  count(*) FILTER (length(code) % 3 = 0) AS high, count(*) FILTER (length(code) % 3 = 1) AS medium, count(*) FILTER (length(code) % 3 = 2) AS low FROM ({PQ.ORACLE['h20_code_snippets']}) GROUP BY page_id"""


def _g14(spark, sf):
    pages, log, robots = SQ.headed_pages(spark, sf), spark_table(spark, sf, "fetch_log"), spark_table(spark, sf, "site_robots")
    probe = pages.select("page_id", F.concat(F.regexp_replace("url", "/$", ""), F.lit(".md")).alias("probe"))
    good = log.filter("status_code BETWEEN 200 AND 299").select(F.col("url").alias("probe")).distinct().withColumn("probe_ok", F.lit(True))
    facts = pages.select(
        "page_id", U.base_url("url").alias("base_url"), F.col("html").contains("application/ld+json").alias("has_jsonld_text"),
        F.col("html").rlike(r"(?i)href=[\"'][^\"']*\.md[\"']").alias("md_link"),
    )
    joined = (
        facts.join(probe.join(good, "probe", "left"), "page_id").join(PG.site_file_flags(pages, log, robots), "page_id").join(robots, "base_url", "left")
    )
    return G.legacy_readiness(joined.withColumn("has_md", F.col("md_link") | F.col("probe_ok").isNotNull()))


QUERIES["g14_legacy_readiness"] = _g14
_ALLOW = " OR ".join(f"(contains(b, '{u}') AND regexp_matches(b, '(?is)User-agent:\\s*{u}.*?Allow:'))" for u in K.LEGACY_AGENTS)
ORACLE["g14_legacy_readiness"] = f"""SELECT page_id, {_ALLOW} AS allows_ai, CAST(least(100, {_IF('llms_found', 30)} + {_IF('llms_full_found', 20)} + {_IF(_ALLOW, 20)} + {_IF("contains(html, 'application/ld+json')", 15)}
  + {_IF(f'''regexp_matches(html, '(?i)href=["''][^"'']*\\.md["'']') OR regexp_replace(url, '/$', '') || '.md' IN (SELECT url FROM {_OKURL})''', 15)}) AS BIGINT) AS legacy_score
  FROM (SELECT p.page_id, p.url, p.html, f.llms_found, f.llms_full_found, coalesce(r.body, '') AS b FROM {AP} p JOIN {FLAGS} f ON f.page_id = p.page_id LEFT JOIN {SROB} r ON r.base_url = {D.base('p.url')})"""

QUERIES["g15_session_status"] = lambda spark, sf: G.session_status(spark_table(spark, sf, "artifacts"))
ORACLE["g15_session_status"] = f"""SELECT session_id, CASE WHEN source IS NOT NULL THEN 'completed' WHEN bad THEN 'failed' ELSE 'in_progress' END AS status, source FROM (
  SELECT session_id, CASE WHEN bool_or(artifact = 'sitemap-health') THEN 'sitemap' WHEN bool_or(artifact = 'report') THEN 'report' WHEN bool_or(artifact = 'dimensions') AND bool_or(artifact = 'content') THEN 'dimensions' END AS source,
  bool_or(artifact = 'status' AND state IN ('failed', 'rejected')) AS bad FROM {oracle_table('artifacts')} GROUP BY session_id)"""

QUERIES["g16_sitemap_mode_report"] = lambda spark, sf: G.sitemap_mode_report(P.health_summary(P.classify_sitemap_url(spark_table(spark, sf, "link_log"))))
ORACLE["g16_sitemap_mode_report"] = f"""SELECT domain, health_pct AS overall, CAST(1 AS BIGINT) AS dimensions_analyzed, 'high' AS confidence, total, healthy, broken, access_denied, timeouts, other_errors FROM {SQ.health_sql(SQ.P6_SQL)}"""

_CT = "CASE page_id % 3 WHEN 0 THEN 'product-guide' ELSE 'tutorial' END"


def _g17(spark, sf):
    s = L.link_summary(spark_table(spark, sf, "audit_pages"), _links(spark, sf))
    forced, kept = G.structure_fallback(F.col("sub_pages"), F.expr(_CT)), G.structure_fallback(F.col("sub_pages"), F.expr(_CT), True)
    return s.select("page_id", forced["structure"].alias("structure"), forced["confidence"].alias("confidence"), forced["content_type"].alias("forced_type"), kept["content_type"].alias("kept_type"))


QUERIES["g17_structure_fallback"] = _g17
ORACLE["g17_structure_fallback"] = f"""SELECT page_id, CASE WHEN len(sub_pages) > 3 THEN 'multi_topic' ELSE 'single_topic' END AS structure, CAST(50 AS BIGINT) AS confidence,
  CASE WHEN page_id % 3 = 0 THEN 'product-guide' ELSE 'mixed' END AS forced_type, {_CT} AS kept_type FROM {SUBS}"""


def _g18(spark, sf):
    f, signals = (settled(x) for x in _features_and_signals(spark, sf))
    tiers = spark_table(spark, sf, "audit_pages").select("page_id", F.expr(_TIERS).alias("citation_tier"))
    recs = G.merge_recommendations(G.recommendation_rules(f), G.citation_recommendations(tiers), G.detection_notes(signals))
    return G.report(f, recs, V.detection_report(signals))


def report_rows(spark, sf):
    """The nested report of every page as (page_id, part, pos, name, value)."""
    r = _g18(spark, sf)
    one = lambda part, value: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("name"), value.cast("string").alias("value"))
    many = lambda part, col, pos, name, value: F.transform(
        F.coalesce(F.col(col), F.array()), lambda x: F.struct(F.lit(part).alias("part"), pos(x).cast("long").alias("pos"), x[name].alias("name"), x[value].alias("value"))
    )
    rows = F.concat(
        F.array(one("overall", F.col("overall")), one("grade", F.col("grade")), one("label", F.col("label")), one("discoverability", F.col("scores.discoverability"))),
        many("recommendation", "recommendations", lambda x: x["position"], "rule", "priority"),
        many("site", "site_signals", lambda x: F.lit(0), "signal", "status"), many("page", "page_signals", lambda x: F.lit(0), "signal", "status"),
    )
    return r.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


QUERIES["g18_report"] = report_rows


_SITE = D.q(V.SITE_SIGNALS)
ORACLE["g18_report"] = f"""WITH r AS ({ORACLE["g5_merge_recommendations"]}), g AS ({ORACLE["g2_overall_and_grade"]}), s AS ({ORACLE["g1_readiness_scores"]})
SELECT page_id, 'overall' AS part, CAST(0 AS BIGINT) AS pos, '' AS name, CAST(overall AS VARCHAR) AS value FROM g UNION ALL SELECT page_id, 'grade', 0, '', grade FROM g
UNION ALL SELECT page_id, 'label', 0, '', {_LABEL} FROM g LEFT JOIN (SELECT page_id, count(*) AS n FROM r GROUP BY page_id) c USING (page_id) UNION ALL SELECT page_id, 'discoverability', 0, '', CAST(discoverability AS VARCHAR) FROM s
UNION ALL SELECT page_id, 'recommendation', position, rule, priority FROM r
UNION ALL SELECT page_id, CASE WHEN signal IN ({_SITE}) THEN 'site' ELSE 'page' END, 0, signal, status FROM ({SQ.ORACLE["p9_evidence_signals"]})"""
