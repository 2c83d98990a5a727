"""Registered queries over URL columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import contains_any
from doccensus.operators import links
from doccensus.plans import oracle_frag as D
from doccensus.plans.inputs import oracle_table, spark_table

QUERIES: dict = {}
ORACLE: dict = {}
AP = oracle_table("audit_pages")


def _pages(spark, sf):
    return spark_table(spark, sf, "audit_pages").select("page_id", "url")


def _project(name, sql, **cols):
    """Register a one-select query over the audited pages."""
    QUERIES[name] = lambda spark, sf: _pages(spark, sf).select("page_id", *[fn().alias(k) for k, fn in cols.items()])
    ORACLE[name] = sql


_NORM = f"""CASE WHEN strlen({D.host('url')}) = 0 THEN url ELSE {D.base('url')}
  || CASE WHEN {D.path('url')} <> '/' AND {D.path('url')} LIKE '%/' THEN {D.noslash(D.path('url'))} ELSE {D.path('url')} END
  || coalesce((SELECT '?' || string_agg(k || '=' || v, '&' ORDER BY k) FROM (
       SELECT k, arg_min(v, i) AS v FROM (
         SELECT split_part(p, '=', 1) AS k, regexp_extract(p, '=(.*)$', 1) AS v, i
         FROM (SELECT unnest(string_split({D.query('url')}, '&')) AS p, generate_subscripts(string_split({D.query('url')}, '&'), 1) AS i)
         WHERE p <> '') GROUP BY k)), '') END"""

# the same pages with repeated and unsorted query keys as well
_U1_SRC = "concat(url, CASE WHEN page_id % 4 = 0 AND instr(url, '?') > 0 AND instr(url, '#') = 0 THEN '&page=9&b&a=1' ELSE '' END)"


def u1_normalize_url(spark, sf):
    p = _pages(spark, sf).withColumn("url", F.expr(_U1_SRC))
    return p.select("page_id", U.normalize_url("url").alias("normalized"))


QUERIES["u1_normalize_url"] = u1_normalize_url
ORACLE["u1_normalize_url"] = f"SELECT page_id, {_NORM} AS normalized FROM (SELECT page_id, {_U1_SRC} AS url FROM {AP})"

_project(
    "u2_cache_key",
    f"""SELECT page_id, 'session-' || left(sha256(n || '#' || CASE WHEN page_id % 2 = 0 THEN 'with-context' ELSE 'without-context' END), 12) AS session_key
    FROM (SELECT page_id, {_NORM} AS n FROM {AP})""",
    session_key=lambda: U.cache_key("url", F.when(F.col("page_id") % 2 == 0, "with-context").otherwise("without-context")),
)

_project(
    "u3_kb_domain",
    f"""SELECT page_id, replace({D.root2(D.nowww(D.host('url')))}, '.', '-') AS kb_domain,
    regexp_replace('not a url ' || url, '[^a-zA-Z0-9-]', '-', 'g') AS fallback FROM {AP}""",
    kb_domain=lambda: U.kb_domain("url"),
    fallback=lambda: U.kb_domain(F.concat(F.lit("not a url "), F.col("url"))),
)

_HOSTX = "CASE page_id % 3 WHEN 0 THEN replace({h}, 'example.com', 'example.co.uk') WHEN 1 THEN concat('docs.', {h}) ELSE {h} END"


def _hosts(spark, sf):
    return _pages(spark, sf).withColumn("h", U.host("url")).withColumn("h", F.expr(_HOSTX.format(h="h")))


_HOSTS = f"(SELECT page_id, {_HOSTX.format(h='h')} AS h FROM (SELECT page_id, {D.host('url')} AS h FROM {AP}))"
_REG = f"""CASE WHEN {D.root2(D.nowww('h'))} IN ({D.q(K.MULTI_PART_TLDS)}) AND len(string_split({D.nowww('h')}, '.')) > 2
  THEN array_to_string(string_split({D.nowww('h')}, '.')[len(string_split({D.nowww('h')}, '.')) - 2:], '.') ELSE {D.root2(D.nowww('h'))} END"""

QUERIES["u4_registrable_domain"] = lambda spark, sf: _hosts(spark, sf).select(
    "page_id", U.registrable_domain("h").alias("registrable")
)
ORACLE["u4_registrable_domain"] = f"SELECT page_id, {_REG} AS registrable FROM {_HOSTS}"


def u5_is_docs_subdomain(spark, sf):
    h = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("docs."), U.root_domain("h"))).otherwise(F.col("h"))
    return _hosts(spark, sf).withColumn("h", h).select("page_id", U.is_docs_subdomain("h").alias("docs_host"))


QUERIES["u5_is_docs_subdomain"] = u5_is_docs_subdomain
ORACLE["u5_is_docs_subdomain"] = f"""
WITH x AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'docs.' || {D.root2('h')} ELSE h END AS h FROM {_HOSTS}),
r AS (SELECT page_id, {D.nowww('h')} AS h, {_REG} AS r FROM x)
SELECT page_id, h <> r AND lower(left(h, greatest(length(h) - length(r) - 1, 0))) IN ({D.q(K.DOCS_SUBDOMAINS)}) AS docs_host FROM r"""

_project(
    "u6_url_match_key",
    f"""SELECT page_id, {D.match_key('url')} AS match_key, {D.nowww(D.host('url'))} || {D.noslash(D.path('url'))} AS host_path FROM {AP}""",
    match_key=lambda: U.match_key("url"),
    host_path=lambda: U.host_path_key("url"),
)


def u7_resolve_url(spark, sf):
    """Links of the audited pages, resolved against the page."""
    p = spark_table(spark, sf, "audit_pages")
    hrefs = p.select("page_id", "url", F.posexplode(links.hrefs("html")).alias("pos", "href"))
    return hrefs.select("page_id", F.col("pos").cast("long").alias("pos"), U.resolve_url("href", "url").alias("resolved"))


QUERIES["u7_resolve_url"] = u7_resolve_url
# every dot segment of the derived links, resolved case by case
_HREFS = f"""(SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1) AS h FROM {AP}))"""
_DIR = f"regexp_extract({D.path('url')}, '^(.*/)', 1)"
ORACLE["u7_resolve_url"] = f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, CASE
  WHEN regexp_matches(href, '^https?://') THEN href
  WHEN href LIKE '//%' THEN {D.scheme('url')} || ':' || href
  WHEN href LIKE '/%' THEN {D.base('url')} || href
  WHEN href LIKE '#%' THEN regexp_replace({D.base('url')} || {D.path('url')} || coalesce('?' || nullif({D.query('url')}, ''), ''), '$', '') || href
  WHEN href LIKE '?%' THEN {D.base('url')} || {D.path('url')} || href
  WHEN href LIKE '../up/./%' THEN {D.base('url')} || coalesce(nullif(regexp_extract({_DIR}, '^(.*/)[^/]+/$', 1), ''), '/') || 'up/' || substring(href, 9)
  ELSE {D.base('url')} || {_DIR} || href END AS resolved
FROM {_HREFS}"""

_SEG = D.segs(D.path("url"))
_project(
    "u8_docs_subpath",
    f"""SELECT page_id, CASE WHEN len({_SEG}) >= 1 AND lower(({_SEG})[1]) IN ({D.q(K.DOCS_PATH_SEGMENTS)}) THEN '/' || ({_SEG})[1] END AS subpath,
    CASE WHEN page_id % 5 = 0 THEN '/handbook/x' WHEN len({_SEG}) >= 2 AND lower(({_SEG})[1]) IN ({D.q(K.DOCS_PATH_SEGMENTS)}) THEN '/' || ({_SEG})[1] END AS strict_subpath
    FROM {AP}""",
    subpath=lambda: U.docs_subpath("url"),
    strict_subpath=lambda: U.docs_subpath(
        "url", 2, F.when(F.col("page_id") % 5 == 0, F.concat(U.base_url("url"), F.lit("/handbook/x/llms.txt")))
    ),
)


def u9_walk_up(spark, sf):
    return _pages(spark, sf).select("page_id", F.posexplode(U.walk_up("url", "llms.txt")).alias("pos", "candidate")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "candidate"
    )


QUERIES["u9_walk_up"] = u9_walk_up
ORACLE["u9_walk_up"] = f"""
SELECT page_id, CAST(n - 1 - d AS BIGINT) AS pos, {D.base('url')} || '/' || array_to_string(s[1:d], '/') || '/llms.txt' AS candidate
FROM (SELECT page_id, url, {_SEG} AS s, len({_SEG}) AS n FROM {AP}), generate_series(1, 20) AS g(d)
WHERE n >= 2 AND d <= n - 1 AND d >= n - 3"""

_project(
    "u10_input_type",
    f"""SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'issue-discovery' WHEN contains(lower(u), 'sitemap.xml') THEN 'sitemap' ELSE 'doc' END AS input_type
    FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '/SiteMap.xml' ELSE url END AS u FROM {AP})""",
    input_type=lambda: U.input_type(
        F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/SiteMap.xml"))).otherwise(F.col("url")),
        F.when(F.col("page_id") % 10 == 3, F.lit("issue-discovery")),
    ),
)
_project(
    "u11_is_non_doc_url",
    "SELECT page_id, " + " OR ".join(f"contains(lower(url), '{x}')" for x in K.NON_DOC_URL_PARTS) + f" AS non_doc FROM {AP}",
    non_doc=lambda: U.is_non_doc_url("url"),
)

_WORDS = rf"""list_filter(list_transform(flatten(list_transform({_SEG}, lambda p, i:
  string_split_regex(CASE WHEN i = len({_SEG}) THEN regexp_replace(p, '(?i)\.(html?|php|jsp|aspx|pdf|md|txt)$', '') ELSE p END, '[-_]'))),
  lambda w: lower(w)), lambda w: w <> '')"""
_project(
    "u12_slug_words",
    f"SELECT page_id, array_to_string({_WORDS}, ' ') AS words FROM {AP}",
    words=lambda: F.array_join(U.slug_words("url"), " "),
)


def u13_slug_typos(spark, sf):
    hits = U.slug_typo_hits("url")
    return _pages(spark, sf).select(
        "page_id",
        F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["segment"], h["suggestion"], h["edit_distance"])), ",").alias("typos"),
        F.when(F.size(hits) > 0, "issues-found").otherwise("clean").alias("status"),
    )


QUERIES["u13_slug_typos"] = u13_slug_typos
_TYPO_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in K.SLUG_TYPOS.items())
SLUG_HITS = f"""(WITH t(seg, fix) AS (VALUES {_TYPO_VALUES}),
w AS (SELECT page_id, unnest({_WORDS}) AS seg, generate_subscripts({_WORDS}, 1) AS i FROM {AP})
SELECT page_id, string_agg(seg || ':' || fix || ':' || levenshtein(seg, fix), ',' ORDER BY i) AS typos, count(*) AS n FROM w JOIN t USING (seg)
  WHERE seg NOT IN ({D.q(K.SLUG_ALLOWED_TERMS)}) AND length(seg) > 2 AND NOT regexp_full_match(seg, '[0-9]+') GROUP BY page_id)"""
ORACLE["u13_slug_typos"] = f"""WITH h AS {SLUG_HITS}
SELECT page_id, coalesce(typos, '') AS typos, CASE WHEN typos IS NULL THEN 'clean' ELSE 'issues-found' END AS status FROM {AP} p LEFT JOIN h USING (page_id)"""

_ODD = "CASE page_id % 4 WHEN 0 THEN concat('ftp', substring(url, 5)) WHEN 1 THEN substring(url, 9) ELSE upper(url) END"
QUERIES["u14_valid_http_url"] = lambda spark, sf: _pages(spark, sf).select(
    "page_id", U.is_http_url(F.expr(_ODD)).alias("valid")
)
ORACLE["u14_valid_http_url"] = f"SELECT page_id, regexp_matches({_ODD}, '^(?i)https?://[^/?#\\s]+') AS valid FROM {AP}"


def u15_is_related_domain(spark, sf):
    """Hosts of each page's links against the page host."""
    p = spark_table(spark, sf, "audit_pages")
    h = p.select(U.host("url").alias("page_host"), F.explode(links.hrefs("html")).alias("href")).select(
        "page_host", U.host("href").alias("link_host")
    )
    alias = F.when(F.col("link_host") == "github.io", F.lit("pages.github.com")).otherwise(F.col("page_host"))
    return (
        h.filter(F.col("link_host") != "")
        .withColumn("page_host", alias)
        .distinct()
        .select("page_host", "link_host", U.is_related_domain("link_host", "page_host").alias("related"))
    )


QUERIES["u15_is_related_domain"] = u15_is_related_domain
_GROUP_VALUES = ", ".join(f"('{n}', {i})" for i, g in enumerate(K.RELATED_DOMAIN_GROUPS) for n in g)
ORACLE["u15_is_related_domain"] = f"""
WITH g(root, grp) AS (VALUES {_GROUP_VALUES}),
h AS (SELECT {D.host('url')} AS page_host, {D.host('href')} AS link_host FROM {_HREFS}),
x AS (SELECT DISTINCT CASE WHEN link_host = 'github.io' THEN 'pages.github.com' ELSE page_host END AS page_host, link_host FROM h WHERE link_host <> '')
SELECT page_host, link_host, page_host = link_host OR {D.root2('page_host')} = {D.root2('link_host')}
  OR coalesce((SELECT grp FROM g WHERE root = {D.root2('page_host')}) = (SELECT grp FROM g WHERE root = {D.root2('link_host')}), false) AS related FROM x"""

_TYPED = "CASE page_id % 4 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN 'HTTPS://www.knock.app/a/b' WHEN 2 THEN substring(url, 9) ELSE url END"
QUERIES["u16_clean_domain"] = lambda spark, sf: _pages(spark, sf).select(
    "page_id", U.clean_domain(F.expr(_TYPED)).alias("domain"), U.with_scheme(F.expr(_TYPED)).alias("with_scheme")
)
ORACLE["u16_clean_domain"] = rf"""
SELECT page_id, CASE WHEN d = 'knock.app' THEN 'docs.knock.app' ELSE d END AS domain,
  CASE WHEN regexp_matches(t, '^(?i)https?://') THEN t ELSE 'https://' || t END AS with_scheme
FROM (SELECT page_id, t, regexp_replace(regexp_replace(regexp_replace({D.trim('t')}, '^(?i)https?://', ''), '^www\.', ''), '/.*$', '') AS d
  FROM (SELECT page_id, {_TYPED} AS t FROM {AP}))"""


def u17_docs_url_filter(spark, sf):
    p = _pages(spark, sf).withColumn("site", U.host("url"))
    return links.docs_url_filter(p, "site", "url").select("page_id", "site", "url")


QUERIES["u17_docs_url_filter"] = u17_docs_url_filter
ORACLE["u17_docs_url_filter"] = rf"""
SELECT page_id, site, url FROM (SELECT page_id, {D.host('url')} AS site, url, regexp_matches(url, '(?i){K.DOCS_URL_PATTERN}') AS m FROM {AP}) a
WHERE m OR (NOT EXISTS (SELECT 1 FROM {AP} b WHERE {D.host('b.url')} = a.site AND regexp_matches(b.url, '(?i){K.DOCS_URL_PATTERN}'))
  AND NOT regexp_matches(url, '(?i){K.ASSET_URL_PATTERN}') AND NOT contains(url, '/tag/') AND NOT contains(url, '/category/'))"""


def u18_ip_hash(spark, sf):
    e = spark_table(spark, sf, "events")
    ip = lambda k: F.when(F.col("user_id") % 4 == k, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    return e.select("event_id", U.client_ip_hash(ip(0), ip(1), ip(2)).alias("ip_hash"))


QUERIES["u18_ip_hash"] = u18_ip_hash
ORACLE["u18_ip_hash"] = """SELECT event_id, left(sha256(CASE WHEN user_id % 4 = 3 THEN 'unknown' ELSE '10.0.0.' || CAST(user_id AS VARCHAR) END), 16) AS ip_hash FROM events"""
