"""Registered queries over robots.txt, llms.txt, sitemaps and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions import urls as U
from doccensus.functions.common import settled
from doccensus.operators import evidence as V
from doccensus.operators import probes as P
from doccensus.operators import robots as R
from doccensus.operators import sitefiles as S
from doccensus.plans import oracle_frag as D
from doccensus.plans import pages_queries as PQ
from doccensus.plans.inputs import oracle_table, spark_table

QUERIES: dict = {}
ORACLE: dict = {}
AP, ROB, LLMS, MAPS, LOG = (
    oracle_table(x) for x in ("audit_pages", "robots_files", "llms_files", "sitemap_files", "fetch_log")
)
HEADERS, LINKLOG, SITES, SROB, FULL = (
    oracle_table(x) for x in ("page_headers", "link_log", "sites", "site_robots", "llms_full_files")
)


def _t(name):
    return lambda spark, sf: spark_table(spark, sf, name)


# ── robots.txt ──────────────────────────────────────────────────────────

_RL = f"""SELECT domain, i, l, lower(l) LIKE 'user-agent:%' AS ua, l = '' OR l LIKE '#%' AS gap FROM (
  SELECT domain, i, {D.trim('x')} AS l FROM (SELECT domain, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM {ROB} WHERE body IS NOT NULL))"""
_RB = f"""lines AS ({_RL}),
marked AS (SELECT *, coalesce(lag(ua) OVER (PARTITION BY domain ORDER BY i), false) AS prev_ua FROM lines),
numbered AS (SELECT *, sum(CASE WHEN ua AND NOT prev_ua THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY i) - 1 AS block FROM marked),
blocks AS (SELECT domain, CAST(block AS BIGINT) AS block,
  array_to_string(list_sort(list(DISTINCT {D.trim('substring(l, 12)')}) FILTER (ua)), ',') AS agents,
  bool_or(NOT ua AND NOT gap AND ((lower(l) LIKE 'allow:%' AND {D.trim('substring(l, 7)')} <> '') OR (lower(l) LIKE 'disallow:%' AND {D.trim('substring(l, 10)')} = ''))) AS has_allow,
  bool_or(NOT ua AND NOT gap AND lower(l) LIKE 'disallow:%' AND {D.trim('substring(l, 10)')} = '/') AS disallow_all
  FROM numbered WHERE block >= 0 GROUP BY domain, block)"""

QUERIES["r1_robots_blocks"] = lambda spark, sf: R.robots_blocks(spark_table(spark, sf, "robots_files")).withColumn(
    "agents", F.array_join("agents", ",")
)
ORACLE["r1_robots_blocks"] = f"WITH {_RB} SELECT * FROM blocks"

_STATUS = f"""{_RB}, ag AS (SELECT unnest({D.lst(K.AI_CRAWLERS)}) AS crawler),
cand AS (SELECT d.domain, crawler, block, list_contains(string_split(agents, ','), crawler) AS own, list_contains(string_split(agents, ','), '*') AND (has_allow OR disallow_all) AS star,
  CASE WHEN disallow_all AND NOT has_allow THEN 'blocked' ELSE 'allowed' END AS v FROM (SELECT domain FROM {ROB}) d CROSS JOIN ag LEFT JOIN blocks b ON b.domain = d.domain),
status AS (SELECT domain, crawler, coalesce(arg_min(v, block) FILTER (own), arg_min(v, block) FILTER (star), 'not-mentioned') AS status FROM cand GROUP BY domain, crawler)"""
QUERIES["r2_crawler_status"] = lambda spark, sf: R.crawler_status(spark_table(spark, sf, "robots_files"))
ORACLE["r2_crawler_status"] = f"WITH {_STATUS} SELECT domain, crawler, status, status = 'blocked' AS blocked FROM status"

QUERIES["r3_bot_status_v1"] = lambda spark, sf: R.bot_status_v1(spark_table(spark, sf, "robots_files"))
_DENY, _ALLOW = D.trim("substring(l, 10)"), "lower(l) LIKE 'allow:%'"
ORACLE["r3_bot_status_v1"] = f"""WITH lines AS ({_RL}), ag AS (SELECT unnest({D.lst(R.BOTS_V1)}) AS bot),
u AS (SELECT bot, domain, i, l, ua, {D.trim('substring(l, 12)')} AS name, max(CASE WHEN ua THEN i END) OVER (PARTITION BY bot, domain ORDER BY i) AS sec FROM lines, ag),
s AS (SELECT a.*, b.name AS sec_name FROM u a LEFT JOIN u b ON a.bot = b.bot AND a.domain = b.domain AND a.sec = b.i),
own_start AS (SELECT bot, domain, min(i) AS st FROM s WHERE ua AND name = bot GROUP BY bot, domain),
own_end AS (SELECT s.bot, s.domain, min(i) AS en FROM s JOIN own_start o ON s.bot = o.bot AND s.domain = o.domain WHERE ua AND i > st AND name <> s.bot GROUP BY s.bot, s.domain),
own AS (SELECT s.bot, s.domain, bool_or({_ALLOW} OR (lower(l) LIKE 'disallow:%' AND {_DENY} = '')) AS al, bool_or(lower(l) LIKE 'disallow:%' AND {_DENY} <> '') AS dn
  FROM s JOIN own_start o ON s.bot = o.bot AND s.domain = o.domain LEFT JOIN own_end e ON s.bot = e.bot AND s.domain = e.domain WHERE NOT ua AND i > st AND i < coalesce(en, 1000000) GROUP BY s.bot, s.domain),
w AS (SELECT *, sec_name = bot OR sec_name = '*' AS inside, {_ALLOW} OR (lower(l) LIKE 'disallow:%' AND {_DENY} = '') AS al, lower(l) LIKE 'disallow:%' AND {_DENY} = '/' AS dn FROM s),
wstop AS (SELECT bot, domain, min(i) AS en FROM (SELECT *, bool_or(NOT ua AND inside AND (al OR dn)) OVER (PARTITION BY bot, domain ORDER BY i) AS seen FROM w) WHERE ua AND seen AND NOT inside GROUP BY bot, domain),
wild AS (SELECT w.bot, w.domain, bool_or(al) AS al, bool_or(dn) AS dn FROM w LEFT JOIN wstop e ON w.bot = e.bot AND w.domain = e.domain WHERE NOT ua AND inside AND i < coalesce(en, 1000000) GROUP BY w.bot, w.domain)
SELECT d.domain, ag.bot, CASE WHEN coalesce(body, '') = '' THEN 'not-mentioned'
  WHEN contains(body, ag.bot) THEN CASE WHEN coalesce(own.dn, false) AND NOT coalesce(own.al, false) THEN 'blocked' WHEN coalesce(own.al, false) THEN 'allowed' ELSE 'not-mentioned' END
  WHEN coalesce(wild.dn, false) AND NOT coalesce(wild.al, false) THEN 'blocked' WHEN coalesce(wild.al, false) THEN 'allowed' ELSE 'not-mentioned' END AS status
FROM {ROB} d CROSS JOIN ag LEFT JOIN own ON own.bot = ag.bot AND own.domain = d.domain LEFT JOIN wild ON wild.bot = ag.bot AND wild.domain = d.domain"""

QUERIES["r4_sitemap_directive"] = lambda spark, sf: spark_table(spark, sf, "robots_files").select(
    "domain", R.sitemap_directive("body").alias("sitemap"), F.expr("nullif(regexp_extract(body, '(?i)Sitemap:\\\\s*(https?://\\\\S+)', 1), '')").alias("strict_sitemap"),
)
ORACLE["r4_sitemap_directive"] = rf"""SELECT domain, {D.trim(PQ.ext('body', r'(?im)^Sitemap:\s*([^\n]+)$'))} AS sitemap, {PQ.ext('body', r'(?i)Sitemap:\s*(https?://\S+)')} AS strict_sitemap FROM {ROB}"""

QUERIES["r5_bot_access_state"] = lambda spark, sf: R.bot_access_state(R.crawler_status(spark_table(spark, sf, "robots_files")))
ORACLE["r5_bot_access_state"] = f"""WITH {_STATUS}, n AS (SELECT domain, count(*) FILTER (status <> 'blocked') AS allowed, count(*) FILTER (status = 'blocked') AS blocked FROM status GROUP BY domain)
SELECT domain, allowed, blocked, CASE WHEN allowed = 0 THEN 'fully_blocked' WHEN blocked > 0 THEN 'partially_blocked' ELSE 'accessible' END AS state FROM n"""

# ── llms.txt ────────────────────────────────────────────────────────────

_LINE = r"^-?\s*\[([^\]]+)\]\(([^)]+)\)(?:\s*:?\s*(.*))?$"
_LLINES = f"""(SELECT * FROM (SELECT base_url, bucket, {D.trim('x')} AS l, i - 1 AS pos FROM (
  SELECT base_url, bucket, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM {LLMS}))
  WHERE l <> '' AND l NOT LIKE '#%' AND l NOT LIKE '>%')"""
_TGT = D.trim(f"regexp_extract(l, '{_LINE}', 2)")
ENTRIES = f"""(SELECT base_url, bucket, pos, CASE WHEN lk THEN {D.trim(f"regexp_extract(l, '{_LINE}', 1)")} ELSE coalesce(nullif(regexp_replace(replace(pl, base_url, ''), '^/', ''), ''), 'Home') END AS title,
  CASE WHEN lk THEN CASE WHEN t LIKE '/%' THEN base_url || t WHEN t NOT LIKE 'http%' THEN base_url || '/' || t ELSE t END ELSE pl END AS url,
  CASE WHEN lk THEN nullif({D.trim(f"regexp_extract(l, '{_LINE}', 3)")}, '') END AS description
  FROM (SELECT *, regexp_matches(l, '{_LINE}') AS lk, nullif(regexp_extract(l, '^(https?://\\S+)', 1), '') AS pl, {_TGT} AS t FROM {_LLINES}) WHERE lk OR pl IS NOT NULL)"""

QUERIES["l1_llms_entries"] = lambda spark, sf: S.llms_entries(spark_table(spark, sf, "llms_files"))
ORACLE["l1_llms_entries"] = f"SELECT * FROM {ENTRIES}"


def _entries_targets(spark, sf):
    entries = S.llms_entries(spark_table(spark, sf, "llms_files"))
    targets = spark_table(spark, sf, "audit_pages").select(F.col("url").alias("target_url"))
    return entries, targets


QUERIES["l2_relevant_entries"] = lambda spark, sf: S.relevant_entries(*_entries_targets(spark, sf))
_SEGU = D.segs("path")
_PLACED = f"placed AS (SELECT bucket, pos, url, {D.host('url')} AS host, {D.noslash(D.path('url'))} AS path FROM {ENTRIES} WHERE strlen({D.host('url')}) > 0)"
_AIMED = f"""aimed AS (SELECT target_url, host, path, CASE WHEN len({_SEGU}) > 1 THEN '/' || array_to_string(({_SEGU})[1:len({_SEGU}) - 1], '/') ELSE '/' END AS parent
  FROM (SELECT url AS target_url, {D.host('url')} AS host, {D.noslash(D.path('url'))} AS path FROM {AP}))"""
ORACLE["l2_relevant_entries"] = f"""WITH {_PLACED}, {_AIMED}
SELECT p.host, 'section' AS scope, a.parent AS scope_path, bucket, pos, url FROM placed p JOIN (SELECT DISTINCT host, parent FROM aimed) a ON p.host = a.host AND starts_with(p.path, a.parent)
UNION ALL SELECT p.host, 'ancestor', a.path, bucket, pos, url FROM placed p JOIN (SELECT DISTINCT host, path FROM aimed) a ON p.host = a.host AND starts_with(a.path, p.path)"""


def _kb_urls(spark, sf):
    p = spark_table(spark, sf, "audit_pages")
    return p.filter(F.length("url") % 3 == 0).select("url")


QUERIES["l3_to_crawl"] = lambda spark, sf: S.to_crawl(*_entries_targets(spark, sf), _kb_urls(spark, sf)).select(
    "target_url", "bucket", "pos", "url", F.col("rank").cast("long").alias("rank")
)
ORACLE["l3_to_crawl"] = f"""WITH {_PLACED}, {_AIMED}
SELECT target_url, bucket, pos, url, rank FROM (SELECT target_url, bucket, pos, url, row_number() OVER (PARTITION BY target_url ORDER BY bucket, pos, url) AS rank
  FROM (SELECT DISTINCT target_url, bucket, pos, url FROM placed p JOIN aimed a ON p.host = a.host AND (starts_with(p.path, a.parent) OR starts_with(a.path, p.path))
    WHERE url NOT IN (SELECT url FROM {AP} WHERE length(url) % 3 = 0)))"""

QUERIES["l4_page_mapping"] = lambda spark, sf: S.page_mapping(spark_table(spark, sf, "audit_pages"), spark_table(spark, sf, "llms_files"))
_NOEXT = lambda x: rf"regexp_replace({x}, '\.(md|html|htm|mdx)$', '')"
_KEY = f"CASE WHEN strlen({D.host('e')}) > 0 THEN {D.match_key('e')} ELSE lower({D.noslash('e')}) END"
MAPPING = f"""(WITH en AS (SELECT base_url, bucket, pos, e, {_KEY} AS k, {D.noslash(f"CASE WHEN e LIKE 'http%' THEN {D.path('e')} ELSE e END")} AS ep FROM (
    SELECT base_url, bucket, pos, coalesce({PQ.ext('l', r'\[[^\]]*\]\(([^)]+)\)')}, CASE WHEN l LIKE 'http%' THEN regexp_extract(l, '^(\\S+)', 1) END) AS e FROM {_LLINES}) WHERE e IS NOT NULL),
  pg AS (SELECT page_id, {D.base('url')} AS base_url, {D.match_key('url')} AS k, {D.noslash(D.path('url'))} AS tp FROM {AP}),
  m AS (SELECT page_id, bucket, pos, e, en.k = pg.k || '/' OR {_NOEXT('en.k')} = {_NOEXT('pg.k')} OR (tp <> '' AND {_NOEXT('ep')} = {_NOEXT('tp')}) AS ex,
    suffix(en.k, pg.k || '.md') OR (tp <> '' AND ep = tp || '.md') AS md FROM pg JOIN en USING (base_url)),
  b AS (SELECT page_id, arg_max(e, bucket * 100000 + pos) FILTER (ex) AS exact_url, arg_max(e, bucket * 100000 + pos) FILTER (md) AS md_url FROM m GROUP BY page_id)
  SELECT p.page_id, CASE WHEN exact_url IS NOT NULL OR md_url IS NOT NULL THEN 'mapped' ELSE 'not_verified' END AS mapping, coalesce(exact_url, md_url) AS mapped_url,
    CASE WHEN md_url IS NOT NULL THEN 'mapped' ELSE 'not_verified' END AS md_mapping, md_url FROM {AP} p LEFT JOIN b ON p.page_id = b.page_id)"""
ORACLE["l4_page_mapping"] = f"SELECT * FROM {MAPPING}"

QUERIES["l5_openapi_specs"] = lambda spark, sf: S.openapi_specs(spark_table(spark, sf, "llms_files"))
ORACLE["l5_openapi_specs"] = rf"""SELECT base_url, bucket, CAST(i - 1 AS BIGINT) AS pos, regexp_extract(l, '(https?://[^\s)]+)', 1) AS spec FROM (
  SELECT base_url, bucket, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM (SELECT base_url, bucket,
    string_split(regexp_extract(body, '(?is)##\s*OpenAPI\s*Specs?\s*\n(.*?)(?:\n##|$)', 1), chr(10)) AS x FROM {LLMS})) WHERE regexp_matches(l, 'https?://[^\s)]+')"""

QUERIES["l6_llms_full_sections"] = lambda spark, sf: S.llms_full_sections(spark_table(spark, sf, "llms_full_files"), "doc_id")
ORACLE["l6_llms_full_sections"] = rf"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, coalesce(nullif({D.trim("regexp_replace(split_part(s, chr(10), 1), '^#+\\s*', '')")}, ''), 'docs') AS title, s AS content
  FROM (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(body, '(?m)^(#\s)', chr(1) || '\1', 'g'), chr(1)),
    lambda s: length({D.trim('s')}) > 100) AS a FROM {FULL} WHERE length(body) > 500))"""


def _preview_inputs(spark, sf):
    llms = spark_table(spark, sf, "llms_files").filter(F.length("base_url") % 3 != 0)
    maps = spark_table(spark, sf, "sitemap_files").filter(F.col("body").contains("<urlset"))
    return (
        llms.select(F.concat("base_url", F.lit("/sitemap-"), "bucket", F.lit(".xml")).alias("site"), "body"),
        maps.select(F.col("url").alias("site"), "body"),
    )


QUERIES["l7_docs_preview"] = lambda spark, sf: S.docs_preview(*_preview_inputs(spark, sf)).withColumn(
    "categories", F.array_join("categories", "|")
)
_PREV_L = f"(SELECT base_url || '/sitemap-' || bucket || '.xml' AS site, string_split(body, chr(10)) AS x, body FROM {LLMS} WHERE length(base_url) % 3 <> 0 AND length(body) > 50)"
ORACLE["l7_docs_preview"] = rf"""
SELECT site, 'llms.txt' AS source, CAST(CASE WHEN n > 0 THEN n ELSE floor(length(body) / 80) END AS BIGINT) AS page_count, array_to_string(c[1:10], '|') AS categories
FROM (SELECT site, body, len(list_filter(x, lambda l: regexp_matches(l, '\[.+\]\(.+\)'))) AS n, list_filter(list_concat(
    list_transform(list_filter(x, lambda l: regexp_matches(l, '^-\s+[A-Z]') AND NOT contains(l, '[')), lambda l: {D.trim("regexp_replace(l, '^-\\s+', '')")}),
    list_transform(list_filter(x, lambda l: l LIKE '## %' OR l LIKE '# %'), lambda l: {D.trim("regexp_replace(l, '^#+\\s+', '')")})), lambda l: l <> '') AS c FROM {_PREV_L})
UNION ALL
SELECT site, 'sitemap.xml', CAST(CASE WHEN len(d) > 0 THEN len(d) ELSE len(u) END AS BIGINT), '' FROM (SELECT url AS site, list_filter(u, lambda x: regexp_matches(x, '(?i){K.DOCS_PREVIEW_PATTERN}')) AS d, u
  FROM (SELECT url, body, list_transform(regexp_extract_all(body, '(?i)<loc>(.*?)</loc>', 1), lambda x: {D.trim('x')}) AS u FROM {MAPS} WHERE contains(body, '<urlset') AND length(body) > 50))
WHERE site NOT IN (SELECT site FROM {_PREV_L})"""

# ── sitemaps ────────────────────────────────────────────────────────────

_LOCS = f"list_transform(regexp_extract_all(body, '(?is)<loc>(.*?)</loc>', 1), lambda x: {D.trim('x')})"
QUERIES["l8_sitemap_urls"] = lambda spark, sf: S.sitemap_urls(spark_table(spark, sf, "sitemap_files"))
ORACLE["l8_sitemap_urls"] = f"""SELECT sitemap_url, CAST(i - 1 AS BIGINT) AS pos, url FROM (SELECT sitemap_url, unnest(d) AS url, generate_subscripts(d, 1) AS i FROM (
  SELECT sitemap_url, list_filter(u, lambda y, j: list_position(u, y) = j) AS d FROM (SELECT url AS sitemap_url, list_filter({_LOCS}, lambda x: regexp_matches(x, '^(?i)https?://')) AS u FROM {MAPS} WHERE contains(body, '<urlset'))))"""


def _roots(spark, sf):
    return spark_table(spark, sf, "sites").select(F.concat("base_url", F.lit("/sitemap.xml")).alias("url"))


QUERIES["l9_expand_sitemap_index"] = lambda spark, sf: S.expand_sitemap_index(_roots(spark, sf), spark_table(spark, sf, "sitemap_files"))
ORACLE["l9_expand_sitemap_index"] = f"""WITH RECURSIVE child AS (SELECT url AS file, contains(body, '<urlset') AS leaf, unnest({_LOCS}) AS loc FROM {MAPS}),
walk(root, file, depth) AS (SELECT base_url || '/sitemap.xml', base_url || '/sitemap.xml', 0 FROM {SITES}
  UNION SELECT w.root, c.loc, w.depth + 1 FROM walk w JOIN child c ON c.file = w.file AND NOT c.leaf WHERE w.depth < 3)
SELECT root, loc AS url, CAST(min(depth) AS BIGINT) AS depth FROM walk JOIN child c ON c.file = walk.file AND c.leaf WHERE regexp_matches(loc, '^(?i)https?://') GROUP BY root, loc"""

QUERIES["l10_discover_sitemap"] = lambda spark, sf: S.discover_sitemap(
    spark_table(spark, sf, "sites"), spark_table(spark, sf, "site_robots"), spark_table(spark, sf, "fetch_log")
)
_DIRECT = ", ".join(f"('{p}', {i})" for i, p in enumerate(S.DIRECT_SITEMAPS))
ORACLE["l10_discover_sitemap"] = f"""WITH n AS (SELECT s.base_url, nullif(regexp_extract(body, '(?i)Sitemap:\\s*(https?://\\S+)', 1), '') AS dir FROM {SITES} s LEFT JOIN {SROB} r ON r.base_url = s.base_url),
p(path, ord) AS (VALUES {_DIRECT}),
c AS (SELECT base_url, ord, base_url || path AS url FROM n, p UNION ALL SELECT base_url, -1, dir FROM n WHERE dir LIKE '%.gz'),
a AS (SELECT c.*, coalesce((SELECT min(status_code) FROM {LOG} l WHERE l.url = c.url), 0) AS st FROM c),
h AS (SELECT base_url, min(ord) AS hit, arg_min(url, ord) AS durl FROM a WHERE ord >= 0 AND st BETWEEN 200 AND 299 GROUP BY base_url),
e AS (SELECT a.base_url, arg_max(note, ord) AS err FROM (SELECT *, CASE WHEN ord = -1 AND st BETWEEN 200 AND 299 THEN 'Unreadable compressed sitemap at ' || url WHEN st = 0 THEN 'Connection failed for ' || url
    WHEN st IN (401, 403) OR ord = -1 THEN 'Access Denied (' || st || ') at ' || url END AS note FROM a) a LEFT JOIN h ON h.base_url = a.base_url WHERE note IS NOT NULL AND ord < coalesce(hit, 99) GROUP BY a.base_url)
SELECT n.base_url, CASE WHEN dir NOT LIKE '%.gz' THEN dir ELSE durl END AS sitemap_url, CASE WHEN dir NOT LIKE '%.gz' THEN 'robots.txt' WHEN durl IS NOT NULL THEN 'direct' ELSE 'not-found' END AS method,
  CASE WHEN dir IS NULL OR dir LIKE '%.gz' THEN err END AS error, CASE WHEN dir LIKE '%.gz' THEN dir END AS skipped_gzip
FROM n LEFT JOIN h ON h.base_url = n.base_url LEFT JOIN e ON e.base_url = n.base_url"""

# ── headers and probes ──────────────────────────────────────────────────


def headed_pages(spark, sf):
    """Audited pages with their response headers as a map."""
    h = spark_table(spark, sf, "page_headers")
    names = {"link": "link", "X-Llms-Txt": "x_llms_txt", "vary": "vary", "X-Robots-Tag": "x_robots_tag"}
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.col(v))]
    return h.select("page_id", "url", "html", F.create_map(*pairs).alias("headers"))


def _hints(spark, sf):
    p = headed_pages(spark, sf)
    return p.withColumn("hint", H.header_hints(F.col("headers"), U.base_url("url")))


QUERIES["h30_link_header_hints"] = lambda spark, sf: _hints(spark, sf).select(
    "page_id", F.array_join("hint.llms_hints", " ").alias("llms_hints"), F.array_join("hint.llms_full_hints", " ").alias("llms_full_hints"),
    F.col("hint.md_header_url").alias("md_header_url"), F.col("hint.vary_accept").alias("vary_accept"), F.col("hint.x_robots_tag").alias("x_robots_tag"),
)
_RES = lambda x: f"CASE WHEN {x} LIKE 'http%' THEN {x} WHEN {x} IS NOT NULL THEN {D.base('url')} || {x} END"
HINTS = f"""(SELECT page_id, url, html, link, vary, x_robots_tag,
  list_concat(list_transform(regexp_extract_all(link, '(?i)<([^>]+)>;\\s*[^,]*rel="llms-txt"', 1), lambda x: {_RES('x')}), CASE WHEN x_llms_txt <> '' THEN [{_RES('x_llms_txt')}] ELSE [] END) AS llms_hints,
  list_transform(regexp_extract_all(link, '(?i)<([^>]+)>;\\s*[^,]*rel="llms-full-txt"', 1), lambda x: {_RES('x')}) AS llms_full_hints,
  {_RES('''nullif(regexp_extract(link, '(?i)<([^>]+)>;\\s*[^,]*(?:rel="alternate"[^,]*type="text/markdown"|type="text/markdown"[^,]*rel="alternate")', 1), '')''')} AS md_header_url FROM {HEADERS})"""
ORACLE["h30_link_header_hints"] = f"""SELECT page_id, array_to_string(llms_hints, ' ') AS llms_hints, array_to_string(llms_full_hints, ' ') AS llms_full_hints, md_header_url,
  contains(lower(vary), 'accept') AS vary_accept, nullif(x_robots_tag, '') AS x_robots_tag FROM {HINTS}"""


def _candidates(spark, sf, filename):
    kind = "hint.llms_full_hints" if "full" in filename else "hint.llms_hints"
    return P.probe_candidates(_hints(spark, sf), filename, F.col(kind))


QUERIES["p1_probe_candidates"] = lambda spark, sf: _candidates(spark, sf, "llms.txt")


def _cands(filename):
    hints = "llms_full_hints" if "full" in filename else "llms_hints"
    seg = D.segs(D.path("url"))
    sub = f"CASE WHEN len({seg}) >= 1 AND lower(({seg})[1]) IN ({D.q(K.DOCS_PATH_SEGMENTS)}) THEN [{{'source': 'subpath-probe', 'url': {D.base('url')} || '/' || ({seg})[1] || '/{filename}'}}] ELSE [] END"
    walk = f"CASE WHEN len({seg}) >= 2 THEN list_transform(range(len({seg}) - 1, greatest(len({seg}) - 4, 0), -1), lambda d: {{'source': 'walk-up-probe', 'url': {D.base('url')} || '/' || array_to_string(({seg})[1:d], '/') || '/{filename}'}}) ELSE [] END"
    return f"""(SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS prio, source, url FROM (
      SELECT page_id, min(i) AS i, arg_min(c.source, i) AS source, c.url AS url FROM (SELECT page_id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM (
        SELECT page_id, list_concat(list_transform({hints}, lambda h: {{'source': 'link-header', 'url': h}}), [{{'source': 'direct-fetch', 'url': {D.base('url')} || '/{filename}'}}], {sub}, {walk},
          [{{'source': 'well-known', 'url': {D.base('url')} || '/.well-known/{filename}'}}]) AS a FROM {HINTS})) GROUP BY page_id, c.url))"""


ORACLE["p1_probe_candidates"] = f"SELECT * FROM {_cands('llms.txt')}"

OK_SQL = f"(status_code BETWEEN 200 AND 299 AND NOT (purpose IN ({D.q(K.EXPECTED_CONTENT_TYPES)}) AND contains(coalesce(content_type, ''), 'text/html')))"
QUERIES["p2_probe_ok"] = lambda spark, sf: P.probe_ok(spark_table(spark, sf, "fetch_log")).select("url", "purpose", "status_code", "ok")
ORACLE["p2_probe_ok"] = f"SELECT url, purpose, status_code, {OK_SQL} AS ok FROM {LOG}"

QUERIES["p3_first_success"] = lambda spark, sf: P.first_success(_candidates(spark, sf, "llms.txt"), spark_table(spark, sf, "fetch_log"), "llms.txt")


def _winners(filename):
    return f"""(SELECT page_id, min(prio) AS prio, arg_min(source, prio) AS source, arg_min(url, prio) AS url FROM {_cands(filename)}
      WHERE url IN (SELECT url FROM {LOG} WHERE purpose = '{filename}' AND {OK_SQL}) GROUP BY page_id)"""


ORACLE["p3_first_success"] = f"SELECT * FROM {_winners('llms.txt')}"

QUERIES["p4_negotiated_markdown"] = lambda spark, sf: P.negotiated_markdown(spark_table(spark, sf, "fetch_log"))
NEG = f"(SELECT DISTINCT url FROM {LOG} WHERE purpose = 'content-negotiation' AND status_code BETWEEN 200 AND 299 AND contains(content_type, 'text/markdown'))"
ORACLE["p4_negotiated_markdown"] = f"SELECT * FROM {NEG}"

QUERIES["p5_classify_link"] = lambda spark, sf: P.classify_link(spark_table(spark, sf, "link_log"))
_LAST = f"""(SELECT domain, url, arg_max(status_code, row(ts, event_id)) FILTER (method = 'HEAD') AS h, max({{'k': row(ts, event_id), 'f': failure}}) FILTER (method = 'HEAD') AS hf,
  arg_max(status_code, row(ts, event_id)) FILTER (method = 'GET') AS g, max({{'k': row(ts, event_id), 'f': failure}}) FILTER (method = 'GET') AS gf FROM {LINKLOG} GROUP BY domain, url)"""
_P5 = f"""(SELECT domain, url, g, CASE WHEN hf.f IS NULL AND h = 404 THEN '404' WHEN hf.f IS NULL AND h > 0 AND h < 400 THEN 'healthy' WHEN g > 0 AND g < 400 THEN 'healthy'
  WHEN hf.f IS NULL AND h > 0 AND g IN (401, 403) THEN 'access-denied' WHEN (hf.f IS NOT NULL OR h = 0) AND gf.f = 'timeout' THEN 'timeout' ELSE 'error' END AS link_state FROM {_LAST} WHERE h IS NOT NULL)"""
ORACLE["p5_classify_link"] = f"""SELECT domain, url, link_state, CASE link_state WHEN '404' THEN 'no page at this address' WHEN 'access-denied' THEN 'refused (' || g || CASE g WHEN 401 THEN ' Unauthorized)' ELSE ' Forbidden)' END
  WHEN 'timeout' THEN 'neither request was answered in time' WHEN 'error' THEN CASE WHEN g > 0 THEN 'HTTP ' || g ELSE 'failed for no known reason' END END AS message FROM {_P5}"""

QUERIES["p6_classify_sitemap_url"] = lambda spark, sf: P.classify_sitemap_url(spark_table(spark, sf, "link_log"))
P6_SQL = f"""(SELECT domain, url, CASE WHEN hf.f = 'timeout' THEN 'timeout' WHEN hf.f IS NOT NULL OR h = 0 THEN 'error' WHEN h = 404 THEN '404' WHEN h IN (401, 403) THEN 'access-denied' WHEN h >= 400 THEN 'error' ELSE 'healthy' END AS link_state,
  CAST(h AS BIGINT) AS status_code FROM {_LAST} WHERE h IS NOT NULL)"""
ORACLE["p6_classify_sitemap_url"] = f"SELECT * FROM {P6_SQL}"

QUERIES["p8_health_summary"] = lambda spark, sf: P.health_summary(P.classify_link(spark_table(spark, sf, "link_log")))


def health_sql(rows):
    return f"""(SELECT domain, count(*) AS total, count(*) FILTER (link_state = 'healthy') AS healthy, count(*) FILTER (link_state = '404') AS broken, count(*) FILTER (link_state = 'access-denied') AS access_denied,
      count(*) FILTER (link_state = 'timeout') AS timeouts, count(*) FILTER (link_state = 'error') AS other_errors, {D.rnd("count(*) FILTER (link_state = 'healthy') / CAST(count(*) AS DOUBLE) * 100")} AS health_pct FROM {rows} GROUP BY domain)"""


ORACLE["p8_health_summary"] = f"SELECT * FROM {health_sql(_P5)}"

QUERIES["p12_probe_stats"] = lambda spark, sf: P.probe_stats(spark_table(spark, sf, "fetch_log"))
ORACLE["p12_probe_stats"] = f"""SELECT purpose, count(*) AS probes, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok_2xx, count(*) FILTER (status_code = 0) AS failed,
  count(*) FILTER (status_code >= 400) AS http_errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms, round(quantile_cont(duration_ms, 0.95), 4) AS slow_ms FROM {LOG} GROUP BY purpose"""

# ── evidence ────────────────────────────────────────────────────────────


def evidence_inputs(spark, sf):
    pages = _hints(spark, sf)
    return pages, spark_table(spark, sf, "fetch_log"), spark_table(spark, sf, "llms_files"), spark_table(spark, sf, "site_robots")


QUERIES["p9_evidence_signals"] = lambda spark, sf: V.evidence_signals(*evidence_inputs(spark, sf))
_ALT_MD = "coalesce(" + ", ".join(
    PQ.ext("html", p.replace('\\"', '"').replace("'", "''")) for p in H.MD_ALTERNATES
) + ")"
_RESB = lambda x: f"CASE WHEN {x} LIKE 'http%' THEN {x} WHEN {x} LIKE '/%' THEN {D.base('url')} || {x} WHEN {x} IS NOT NULL THEN {D.base('url')} || '/' || {x} END"
_GOOD = lambda purpose: f"(SELECT DISTINCT url FROM {LOG} WHERE purpose = '{purpose}' AND {OK_SQL})"
EVIDENCE = f"""(WITH pg AS (SELECT *, {D.base('url')} AS base_url, {_RESB(_ALT_MD)} AS md_alt FROM {HINTS}),
lw AS (SELECT * FROM {_winners('llms.txt')}), fw AS (SELECT * FROM {_winners('llms-full.txt')}),
cl AS (SELECT page_id, string_agg(url, ', ' ORDER BY prio) AS tested FROM {_cands('llms.txt')} GROUP BY page_id),
fullref AS (SELECT base_url, bool_or(regexp_matches(body, '(?i)llms-full\\.txt')) AS has_ref FROM {LLMS} GROUP BY base_url),
sm AS (SELECT s.base_url, coalesce(nullif({D.trim(f"regexp_extract(body, '(?im)^Sitemap:\\s*([^{chr(92)}n]+)$', 1)")}, ''), s.base_url || '/sitemap.xml') AS u FROM {SITES} s LEFT JOIN {SROB} r ON r.base_url = s.base_url)
SELECT page_id, 'llms.txt' AS signal, CASE WHEN lw.url IS NOT NULL THEN 'verified' WHEN len(llms_hints) > 0 THEN 'advertised' ELSE 'not_verified' END AS status,
  CASE WHEN lw.url IS NOT NULL THEN lw.source WHEN len(llms_hints) > 0 THEN 'link-header' ELSE 'none' END AS method, lw.url AS validated_url, 'both' AS audience,
  CASE WHEN lw.url IS NOT NULL AND len(llms_hints) > 0 AND NOT list_contains(llms_hints, lw.url) THEN 'a header names ' || llms_hints[1] || ', which gave nothing; the file is at ' || lw.url
    WHEN lw.url IS NULL AND len(llms_hints) > 0 THEN 'a header announces ' || llms_hints[1] || '; without an answer: ' || tested WHEN lw.url IS NULL THEN 'without an answer: ' || tested END AS note
  FROM pg LEFT JOIN lw USING (page_id) JOIN cl USING (page_id)
UNION ALL SELECT page_id, 'llms-full.txt', CASE WHEN fw.url IS NOT NULL THEN 'verified' WHEN (lw.url IS NOT NULL AND has_ref) OR len(llms_full_hints) > 0 THEN 'advertised' ELSE 'not_verified' END,
  CASE WHEN fw.url IS NOT NULL THEN fw.source WHEN lw.url IS NOT NULL AND has_ref THEN 'llms-txt-reference' WHEN len(llms_full_hints) > 0 THEN 'link-header' ELSE 'none' END, fw.url, 'coding_agents',
  CASE WHEN fw.url IS NOT NULL THEN NULL WHEN lw.url IS NOT NULL AND has_ref THEN 'named in llms.txt but without an answer' WHEN len(llms_full_hints) > 0 THEN 'a header announces ' || llms_full_hints[1] || ', which gave no answer' END
  FROM pg LEFT JOIN fw USING (page_id) LEFT JOIN lw USING (page_id) LEFT JOIN fullref USING (base_url)
UNION ALL SELECT page_id, 'sitemap.xml', CASE WHEN g.url IS NOT NULL THEN 'verified' ELSE 'not_verified' END, CASE WHEN g.url IS NOT NULL THEN 'direct-fetch' ELSE 'none' END, g.url, 'ai_search', NULL
  FROM pg JOIN sm USING (base_url) LEFT JOIN {_GOOD('sitemap.xml')} g ON g.url = sm.u
UNION ALL SELECT page_id, n.f, 'experimental', CASE WHEN g.url IS NOT NULL THEN 'direct-fetch' ELSE 'none' END, g.url, 'coding_agents', CASE WHEN g.url IS NOT NULL THEN n.f || ' is there; it does not count towards the score' END
  FROM pg CROSS JOIN (VALUES ('AGENTS.md', '/AGENTS.md'), ('mcp.json', '/.well-known/mcp.json')) n(f, p) LEFT JOIN (SELECT url FROM {_GOOD('AGENTS.md')} UNION SELECT url FROM {_GOOD('mcp.json')}) g ON g.url = pg.base_url || n.p
UNION ALL SELECT page_id, 'markdown', CASE WHEN neg.url IS NOT NULL OR alt.url IS NOT NULL OR dm.url IS NOT NULL THEN 'verified' WHEN md_alt IS NOT NULL OR md_header_url IS NOT NULL THEN 'advertised' ELSE 'not_verified' END,
  CASE WHEN neg.url IS NOT NULL THEN 'content-negotiation' WHEN alt.url IS NOT NULL THEN 'link-alternate' WHEN dm.url IS NOT NULL THEN 'direct-md-probe' WHEN md_alt IS NOT NULL THEN 'link-alternate' WHEN md_header_url IS NOT NULL THEN 'link-header' ELSE 'none' END,
  coalesce(neg.url, alt.url, dm.url), 'coding_agents', CASE WHEN neg.url IS NULL AND alt.url IS NULL AND dm.url IS NULL AND coalesce(md_alt, md_header_url) IS NOT NULL THEN 'announced at ' || coalesce(md_alt, md_header_url) || ', which gave no answer' END
  FROM pg LEFT JOIN {NEG} neg ON neg.url = pg.url LEFT JOIN {_GOOD('markdown-alternate')} alt ON alt.url = coalesce(md_alt, md_header_url) LEFT JOIN {_GOOD('direct-md')} dm ON dm.url = regexp_replace(pg.url, '/$', '') || '.md'
UNION ALL SELECT page_id, 'content-negotiation', CASE WHEN neg.url IS NOT NULL THEN 'verified' ELSE 'not_verified' END, CASE WHEN neg.url IS NOT NULL THEN 'content-negotiation' ELSE 'none' END, neg.url, 'coding_agents', NULL
  FROM pg LEFT JOIN {NEG} neg ON neg.url = pg.url
UNION ALL SELECT page_id, 'llms-txt-mapping', CASE WHEN lw.url IS NOT NULL THEN mapping ELSE 'not_verified' END, CASE WHEN lw.url IS NOT NULL AND mapping = 'mapped' THEN 'llms-txt-content-match' ELSE 'none' END,
  CASE WHEN lw.url IS NOT NULL THEN mapped_url END, 'both', NULL FROM pg LEFT JOIN lw USING (page_id) JOIN {MAPPING} USING (page_id)
UNION ALL SELECT page_id, 'llms-txt-md-mapping', CASE WHEN lw.url IS NOT NULL THEN md_mapping ELSE 'not_verified' END, CASE WHEN lw.url IS NOT NULL AND md_mapping = 'mapped' THEN 'llms-txt-md-match' ELSE 'none' END,
  CASE WHEN lw.url IS NOT NULL THEN md_url END, 'both', NULL FROM pg LEFT JOIN lw USING (page_id) JOIN {MAPPING} USING (page_id))"""
ORACLE["p9_evidence_signals"] = f"SELECT * FROM {EVIDENCE}"

QUERIES["p10_experimental_signals"] = lambda spark, sf: V.experimental_signals(
    headed_pages(spark, sf), spark_table(spark, sf, "fetch_log")
).select("page_id", "signal", "status", "validated_url")
ORACLE["p10_experimental_signals"] = f"SELECT page_id, signal, status, validated_url FROM {EVIDENCE} WHERE status = 'experimental'"

QUERIES["p11_probe_log"] = lambda spark, sf: V.page_probe_log(*evidence_inputs(spark, sf))
_SINGLE = f"""SELECT page_id, 'map' AS slot, 0 AS prio, 'sitemap.xml' AS purpose, sm.u AS url FROM pg JOIN sm USING (base_url) UNION ALL SELECT page_id, 'alt', 0, 'markdown-alternate', coalesce(md_alt, md_header_url) FROM pg
  UNION ALL SELECT page_id, 'direct', 0, 'direct-md', regexp_replace(url, '/$', '') || '.md' FROM pg UNION ALL SELECT page_id, 'neg', 0, 'content-negotiation', url FROM pg
  UNION ALL SELECT page_id, 'agents', 0, 'AGENTS.md', base_url || '/AGENTS.md' FROM pg UNION ALL SELECT page_id, 'mcp', 0, 'mcp.json', base_url || '/.well-known/mcp.json' FROM pg"""
ORACLE["p11_probe_log"] = f"""WITH pg AS (SELECT *, {D.base('url')} AS base_url, {_RESB(_ALT_MD)} AS md_alt FROM {HINTS}),
sm AS (SELECT s.base_url, coalesce(nullif({D.trim(f"regexp_extract(body, '(?im)^Sitemap:\\s*([^{chr(92)}n]+)$', 1)")}, ''), s.base_url || '/sitemap.xml') AS u FROM {SITES} s LEFT JOIN {SROB} r ON r.base_url = s.base_url),
k AS (SELECT page_id, 'llms' AS slot, prio, 'llms.txt' AS purpose, url FROM {_cands('llms.txt')} UNION ALL SELECT page_id, 'full', prio, 'llms-full.txt', url FROM {_cands('llms-full.txt')} UNION ALL {_SINGLE}),
t AS (SELECT k.*, l.status_code, l.duration_ms, {OK_SQL.replace('purpose IN', 'k.purpose IN')} AS ok FROM k JOIN (SELECT DISTINCT url, purpose, status_code, duration_ms, content_type FROM {LOG}) l ON l.url = k.url AND l.purpose = k.purpose),
w AS (SELECT page_id, slot, min(prio) AS won FROM t WHERE ok GROUP BY page_id, slot)
SELECT t.page_id, url, purpose, status_code, duration_ms FROM t LEFT JOIN w ON w.page_id = t.page_id AND w.slot = t.slot WHERE won IS NULL OR prio <= won"""


def _p11(spark, sf):
    """The nested report as one row per signal and probe."""
    inputs = evidence_inputs(spark, sf)
    harvested = settled(V.harvest(inputs[0], *inputs[2:]))
    report = V.detection_report(V.evidence_signals(*inputs, harvested=harvested), V.page_probe_log(*inputs, harvested=harvested))
    none = F.lit(None).cast("string")
    signal = lambda part: F.transform(
        part, lambda x: F.struct(F.lit(part).alias("part"), x["signal"].alias("name"), x["status"].alias("status"), x["method"].alias("method"), x["validated_url"].alias("url"),
                                 x["note"].alias("note"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("long").alias("duration_ms")),
    )
    probe = F.transform(
        F.coalesce("probes", F.array()), lambda x: F.struct(F.lit("probe").alias("part"), x["purpose"].alias("name"), none.alias("status"), none.alias("method"), x["url"].alias("url"),
                                                            none.alias("note"), x["status_code"].alias("status_code"), x["duration_ms"].alias("duration_ms")),
    )
    return report.select("page_id", F.explode(F.concat(signal("site"), signal("page"), probe)).alias("r")).select("page_id", "r.*")


QUERIES["p11_detection_report"] = _p11

_SITE = D.q(V.SITE_SIGNALS)
ORACLE["p11_detection_report"] = f"""SELECT page_id, CASE WHEN signal IN ({_SITE}) THEN 'site' ELSE 'page' END AS part, signal AS name, status, method, validated_url AS url, note, CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS BIGINT) AS duration_ms
  FROM ({ORACLE["p9_evidence_signals"]}) UNION ALL SELECT page_id, 'probe', purpose, NULL, NULL, url, NULL, status_code, duration_ms FROM ({ORACLE["p11_probe_log"]})"""

QUERIES["p12_page_probe_stats"] = lambda spark, sf: P.probe_stats(V.page_probe_log(*evidence_inputs(spark, sf)), "page_id", "purpose")
ORACLE["p12_page_probe_stats"] = f"""SELECT page_id, purpose, count(*) AS probes, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok_2xx, count(*) FILTER (status_code = 0) AS failed,
  count(*) FILTER (status_code >= 400) AS http_errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms, round(quantile_cont(duration_ms, 0.95), 4) AS slow_ms
  FROM ({ORACLE["p11_probe_log"]}) GROUP BY page_id, purpose"""
