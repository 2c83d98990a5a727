"""Registered queries over citations and developer issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions import urls as U
from doccensus.functions.common import by_shuffle, settled
from doccensus.operators import citations as C
from doccensus.operators import issues as I
from doccensus.operators import sitefiles as S
from doccensus.plans import oracle_frag as D
from doccensus.plans import pages_queries as PQ
from doccensus.plans import sites_queries as SQ
from doccensus.plans.inputs import oracle_table, spark_table

QUERIES: dict = {}
ORACLE: dict = {}
AP, ISS, QUE, REPOS, FILES, CIT, EV = (
    oracle_table(x) for x in ("audit_pages", "issues", "questions", "repos", "repo_files", "citations", "events")
)
NOW = "TIMESTAMP '2024-01-25 12:00:00'"

# ── citations ───────────────────────────────────────────────────────────

_TCUT = "[|\\-–—]"
_TITLES = "CASE page_id % 4 WHEN 0 THEN concat(title, ' | Acme Docs') WHEN 1 THEN concat(title, ' – ', substring(host, 1, 8)) ELSE title END"
_H1X = "CASE page_id % 3 WHEN 0 THEN concat('Acme Docs setup for ', host) WHEN 1 THEN '' ELSE h1 END"


def _page_info(spark, sf):
    p = spark_table(spark, sf, "audit_pages").select(
        "page_id", H.title("html").alias("title"), H.h1("html").alias("h1"), H.meta_description("html").alias("description"), U.host("url").alias("host")
    )
    return p.select("page_id", F.expr(_TITLES).alias("title"), F.expr(_H1X).alias("h1"), "description", F.col("host").alias("domain"))


INFO = f"""(SELECT page_id, {_TITLES} AS title, {_H1X} AS h1, description, host AS domain FROM (
  SELECT page_id, {PQ.TITLE} AS title, {PQ.H1} AS h1, {PQ.META_D} AS description, {D.host('url')} AS host FROM {AP}))"""

QUERIES["c1_template_queries"] = lambda spark, sf: C.template_queries(_page_info(spark, sf))
_BR = lambda x: f"((product <> '' AND contains({x}, product)) OR (length(site) > 2 AND contains({x}, site)))"
_RP = lambda x, w: f"CASE WHEN {w} = '' THEN {x} ELSE replace({x}, {w}, '') END"
ORACLE["c1_template_queries"] = rf"""WITH a AS (SELECT page_id, lower(CASE WHEN len(string_split_regex(title, '{_TCUT}')) > 1 THEN {D.trim(f"string_split_regex(title, '{_TCUT}')[-1]")} ELSE '' END) AS product,
  lower(coalesce(nullif(h1, ''), {D.trim(f"string_split_regex(title, '{_TCUT}')[1]")})) AS topic, lower(split_part(regexp_replace(domain, '^(www|dev|docs|api)\.', ''), '.', 1)) AS site,
  array_to_string(list_filter(string_split_regex(regexp_replace(description, '[.!?,;:]', '', 'g'), '\s+'), lambda w: length(w) > 3)[1:5], ' ') AS phrase FROM {INFO}),
b AS (SELECT *, {_BR('lower(topic)')} AS br, CASE WHEN {_BR('lower(topic)')} THEN {D.squash(_RP(_RP('topic', 'site'), 'product'))} ELSE topic END AS clean FROM a),
r AS (SELECT page_id, 0 AS o, 'high' AS tier, clean AS query FROM b WHERE topic <> '' AND (NOT br OR length(clean) > 5) UNION ALL SELECT page_id, 1, 'mid', 'how to ' || clean FROM b WHERE length(clean) > 5
  UNION ALL SELECT page_id, 2, 'mid', phrase FROM b WHERE length(phrase) > 5 AND NOT {_BR('lower(phrase)')} UNION ALL SELECT page_id, 3, 'low', clean || ' best practices' FROM b WHERE length(clean) > 5
  UNION ALL SELECT page_id, 4, 'low', clean || ' not working' FROM b WHERE length(clean) > 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, tier, query FROM r"""

QUERIES["c2_brand"] = lambda spark, sf: _page_info(spark, sf).select("page_id", C.brand("title", "domain").alias("brand"))
ORACLE["c2_brand"] = rf"""SELECT page_id, coalesce(nullif(CASE WHEN len(string_split_regex(title, '{_TCUT}')) > 1 THEN {D.trim(f"string_split_regex(title, '{_TCUT}')[-1]")} END, ''), upper(left(l, 1)) || substring(l, 2)) AS brand
  FROM (SELECT *, split_part(regexp_replace(domain, '^(www|docs|developer|dev|cms|api|help|support|learn|blog)\.', ''), '.', 1) AS l FROM {INFO})"""


def _citations(spark, sf):
    """Every second target sits on a documentation subdomain."""
    moved = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("target_url", "^(https?://)", "$1docs.")).otherwise(F.col("target_url"))
    only = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(moved, r"^(https?://)docs\.([^/.]+\.)*(example\.[a-z]+)", "$1docs.$3")).otherwise(moved)
    return spark_table(spark, sf, "citations").withColumn("target_url", only)


CITE = rf"(SELECT * REPLACE (CASE WHEN page_id % 2 = 0 THEN regexp_replace(target_url, '^(https?://)([^/.]+\.)*(example\.[a-z]+)', '\1docs.\3') ELSE target_url END AS target_url) FROM {CIT})"
_REG = lambda h: f"""CASE WHEN {D.root2(D.nowww(h))} IN ({D.q(K.MULTI_PART_TLDS)}) AND len(string_split({D.nowww(h)}, '.')) > 2 THEN array_to_string(string_split({D.nowww(h)}, '.')[len(string_split({D.nowww(h)}, '.')) - 2:], '.') ELSE {D.root2(D.nowww(h))} END"""
_DOCSUB = lambda h: f"({D.nowww(h)} <> {_REG(h)} AND lower(left({D.nowww(h)}, greatest(length({D.nowww(h)}) - length({_REG(h)}) - 1, 0))) IN ({D.q(K.DOCS_SUBDOMAINS)}))"
_HPK = lambda u: f"CASE WHEN strlen({D.host(u)}) > 0 THEN {D.nowww(D.host(u))} || {D.noslash(D.path(u))} ELSE {u} END"
_HIT = f"coalesce(contains(cited_url, h) OR ({_DOCSUB('h')} AND contains(cited_url, {_REG('h')})) OR {_HPK('cited_url')} = {_HPK('target_url')}, false)"
CITED = f"""(SELECT page_id, query_pos, tier, bool_or(hit) AS cited, arg_min(cited_url, pos) FILTER (hit) AS first_cited, count(cited_url) AS total_citations
  FROM (SELECT *, {_HIT} AS hit FROM (SELECT *, {D.host('target_url')} AS h FROM {CITE})) GROUP BY page_id, query_pos, tier)"""
QUERIES["c3_cited"] = lambda spark, sf: C.cited(_citations(spark, sf))
ORACLE["c3_cited"] = f"SELECT * FROM {CITED}"

QUERIES["c4_competing_domains"] = lambda spark, sf: C.competing_domains(_citations(spark, sf)).withColumn("competitors", F.array_join("competitors", ","))
ORACLE["c4_competing_domains"] = f"""SELECT page_id, query_pos, array_to_string((list(d ORDER BY pos, d))[1:3], ',') AS competitors FROM (
  SELECT page_id, query_pos, d, min(pos) AS pos FROM (SELECT c.*, {D.nowww(D.host('cited_url'))} AS d, {D.nowww(D.host('target_url'))} AS own FROM {CITE} c JOIN {CITED} r USING (page_id, query_pos) WHERE NOT r.cited AND cited_url IS NOT NULL)
  WHERE d <> '' AND NOT contains(d, own) AND NOT ({_DOCSUB('own')} AND contains(d, {_REG('own')})) AND d NOT IN ({D.q(K.SKIPPED_PLATFORMS)}) GROUP BY page_id, query_pos, d) GROUP BY page_id, query_pos"""

QUERIES["c5_found_rate"] = lambda spark, sf: C.found_rates(C.cited(_citations(spark, sf)))
RATES = f"""(SELECT page_id, avg(CAST(cited AS INTEGER)) AS found_rate, avg(CAST(cited AS INTEGER)) FILTER (tier = 'high') AS high_rate, avg(CAST(cited AS INTEGER)) FILTER (tier = 'mid') AS mid_rate,
  avg(CAST(cited AS INTEGER)) FILTER (tier = 'low') AS low_rate FROM {CITED} GROUP BY page_id)"""
ORACLE["c5_found_rate"] = f"SELECT *, CASE WHEN found_rate >= 0.6 THEN 'high' WHEN found_rate >= 0.3 THEN 'partial' WHEN found_rate > 0 THEN 'low' ELSE 'not-found' END AS citation_tier FROM {RATES}"

from doccensus.operators import scoring as G  # noqa: E402

QUERIES["g3_citation_score"] = lambda spark, sf: C.found_rates(C.cited(_citations(spark, sf))).select("page_id", G.citation_score(F.col("found_rate")).alias("citation_score"))
ORACLE["g3_citation_score"] = f"SELECT page_id, {D.rnd('found_rate * 30')} AS citation_score FROM {RATES}"

# ── classification ──────────────────────────────────────────────────────


def issues(spark, sf):
    return spark_table(spark, sf, "issues").withColumn("labels", F.split("label_text", ";"))


QUERIES["i1_recent_open"] = lambda spark, sf: I.recent_open(issues(spark, sf), F.expr(NOW)).select("repo", "number", F.col("rank").cast("long").alias("rank"))
ORACLE["i1_recent_open"] = f"""SELECT repo, number, rank FROM (SELECT repo, number, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS rank FROM {ISS}
  WHERE state = 'open' AND CAST(created_at AS DATE) > DATE '2024-01-11')"""

_ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_LAB = f"len(list_filter(string_split(lower(label_text), ';'), lambda l: l IN ({D.q(K.DOCS_LABELS)}))) > 0"
RELATED = f"({_LAB} OR {_ANY('lower(title)', K.STRONG_DOCS_SIGNALS)} OR {_ANY('''lower(coalesce(body, ''))''', K.STRONG_DOCS_SIGNALS)} OR {_ANY('''lower(title || ' ' || coalesce(body, ''))''', K.MEDIUM_DOCS_SIGNALS)})"
QUERIES["i2_docs_related_keywords"] = lambda spark, sf: issues(spark, sf).select(
    "number", I.docs_related("title", "body", "labels").alias("docs_related"), F.array_join(I.matched_local_signals("title", "body"), ",").alias("local_signals")
)
ORACLE["i2_docs_related_keywords"] = f"""SELECT number, {RELATED} AS docs_related, array_to_string(list_filter({D.lst(K.LOCAL_DOCS_SIGNALS)}, lambda s: contains(lower(title || ' ' || coalesce(body, '')), s)), ',') AS local_signals FROM {ISS}"""


def _i3(spark, sf):
    i = issues(spark, sf)
    cats = F.when(F.col("number") % 2 == 0, F.array(F.lit("missing-docs"), F.lit("unclear-docs")))
    answers = i.filter("number % 3 = 0").select("number", F.expr("CASE WHEN number % 4 = 0 THEN NULL ELSE number % 150 - 20 END").alias("answer_score"), cats.alias("answer_categories"))
    return I.merge_classification(i, answers, i.filter("number % 5 = 4").select("number")).withColumn("docs_categories", F.array_join("docs_categories", ","))


QUERIES["i3_merge_classification"] = _i3
_RAW = "CASE WHEN number % 4 = 0 OR number % 150 - 20 = 0 THEN 75 ELSE number % 150 - 20 END"
ORACLE["i3_merge_classification"] = f"""SELECT number, a OR f AS docs_related, CAST(CASE WHEN a THEN least(100, greatest(0, {_RAW})) WHEN f THEN 50 ELSE 0 END AS BIGINT) AS docs_confidence,
  CASE WHEN a AND number % 2 = 0 THEN 'missing-docs,unclear-docs' WHEN a OR f THEN 'docs-related' ELSE '' END AS docs_categories
  FROM (SELECT number, number % 3 = 0 AND number % 5 <> 4 AS a, number % 5 = 4 AND {RELATED} AS f FROM {ISS})"""


def _i4(spark, sf):
    b = I.make_batches(issues(spark, sf))
    return b.select("batch", "n", F.array_join(F.transform("items", lambda x: x["number"].cast("string")), ",").alias("numbers"),
                    F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"])).alias("body_chars"))


QUERIES["i4_make_batches"] = _i4
ORACLE["i4_make_batches"] = f"""SELECT batch, count(*) AS n, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers, CAST(sum(length(b)) AS BIGINT) AS body_chars FROM (
  SELECT number, left(coalesce(body, ''), 400) AS b, CAST(floor((row_number() OVER (ORDER BY number) - 1) / 50) AS BIGINT) AS batch FROM {ISS}) GROUP BY batch"""

_KWCASE = "CASE category " + " ".join(f"WHEN '{k}' THEN {D.lst(v)}" for k, v in K.CATEGORY_KEYWORDS.items()) + " ELSE [] END"
_KWTEXT = "lower(title || ' ' || coalesce(body, '') || ' ' || category)"
_DIST = "list_filter({x}, lambda dx, di: list_position({x}, dx) = di)"
KEYS = f"""(SELECT number AS issue_id, site, title, category, {_DIST.format(x='w')} AS keywords FROM (SELECT number, site, title, category,
  list_concat(list_filter(regexp_extract_all({_KWTEXT}, '[a-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{{3,}}') AND x NOT IN ({D.q(K.STOP_WORDS)})), {_KWCASE}) AS w FROM {ISS}))"""


def keyed(spark, sf):
    text = F.concat("title", F.lit(" "), F.coalesce("body", F.lit("")), F.lit(" "), "category")
    return issues(spark, sf).select(F.col("number").alias("issue_id"), "site", "title", "category", I.issue_keywords(text, "category").alias("keywords"))


QUERIES["i5_issue_keywords"] = lambda spark, sf: keyed(spark, sf).select("issue_id", F.array_join("keywords", ",").alias("keywords"))
ORACLE["i5_issue_keywords"] = f"SELECT issue_id, array_to_string(keywords, ',') AS keywords FROM {KEYS}"


def _site_urls(spark, sf):
    return spark_table(spark, sf, "audit_pages").select("page_id", "url", U.kb_domain("url").alias("site"))


QUERIES["i6_keyword_page_match"] = lambda spark, sf: I.keyword_page_match(settled(keyed(spark, sf)), _site_urls(spark, sf).select("site", "url")).select(
    "issue_id", "url", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank")
)
_SITEURL = f"(SELECT DISTINCT url, replace({D.root2(D.nowww(D.host('url')))}, '.', '-') AS site FROM {AP})"
MATCH = f"""(SELECT issue_id, url, score, rank FROM (SELECT issue_id, url, score, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, url) AS rank FROM (
  SELECT issue_id, url, len(list_filter(keywords, lambda k: contains(lower(url), k))) + CASE WHEN contains(lower(url), '/docs/') THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS score FROM {KEYS} k JOIN {_SITEURL} u ON u.site = k.site)
  WHERE score > 0) WHERE rank <= 5)"""
ORACLE["i6_keyword_page_match"] = f"SELECT * FROM {MATCH}"


def _entries(spark, sf):
    return S.llms_entries(spark_table(spark, sf, "llms_files")).select(
        U.kb_domain("base_url").alias("site"), "url", F.concat_ws(" ", "title", "url").alias("title"), "description"
    ).distinct()


QUERIES["i7_keyword_entry_match"] = lambda spark, sf: I.keyword_entry_match(issues(spark, sf), _entries(spark, sf)).select("site", "url", "title", "description", "matches", F.col("rank").cast("long").alias("rank"))
_ENT = f"(SELECT DISTINCT replace({D.root2(D.nowww(D.host('base_url')))}, '.', '-') AS site, url, title || ' ' || url AS title, description FROM {SQ.ENTRIES})"
ORACLE["i7_keyword_entry_match"] = f"""WITH kw AS (SELECT DISTINCT site, w FROM (SELECT site, unnest(string_split_regex(lower(title || ' ' || coalesce(body, '')), '[^a-z0-9_]+')) AS w FROM {ISS}) WHERE length(w) > 3),
  m AS (SELECT e.site, url, title, description, count(*) AS matches FROM {_ENT} e JOIN kw ON kw.site = e.site AND contains(lower(title || ' ' || coalesce(description, '')), w) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY matches DESC, url, lower(title || ' ' || coalesce(description, ''))) AS rank FROM m) WHERE rank <= 15"""


def _vectors(spark, sf):
    e = spark_table(spark, sf, "embeddings")
    return (
        e.filter("label = 0").select(F.col("vec_id").alias("issue_id"), "embedding"),
        e.filter("label <> 0").select(F.col("vec_id").alias("page_key"), "embedding"),
    )


QUERIES["i8_similar_pages"] = lambda spark, sf: I.similar_pages(*_vectors(spark, sf)).select(
    "issue_id", "page_key", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank")
)
SIMILAR = """(SELECT issue_id, page_key, sim, rank FROM (SELECT a.vec_id AS issue_id, b.vec_id AS page_key, sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) AS rank FROM (
  SELECT a, b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label <> 0)) WHERE rank <= 5)"""
ORACLE["i8_similar_pages"] = f"SELECT issue_id, page_key, round(sim, 6) AS similarity, rank FROM {SIMILAR}"

_SIM = "CASE WHEN issue_id % 5 = 0 THEN NULL ELSE CAST((issue_id * 7 + page_id * 3) % 100 AS DOUBLE) / 100 END"
# half of the issues keep their candidates; the html of some pages failed to load
_KEEP = "issue_id % 9 <> 2"


def _pairs(issues, urls):
    m = I.keyword_page_match(issues, urls.select("site", "url")).filter(_KEEP)
    return settled(m.join(by_shuffle(urls.select("url", "page_id")), "url").withColumn("similarity", F.expr(_SIM)).select("issue_id", "page_id", "similarity"))


def _evidence(spark, sf, issues=None):
    issues = settled(keyed(spark, sf)) if issues is None else issues
    pages = spark_table(spark, sf, "audit_pages").filter("page_id % 13 <> 5").select("page_id", "html")
    return I.page_evidence(_pairs(issues, settled(_site_urls(spark, sf))), issues, pages)


PAIRS = f"(SELECT issue_id, page_id, {_SIM} AS similarity FROM {MATCH} m JOIN {AP} p ON p.url = m.url WHERE {_KEEP})"
_HAS = lambda *w: _ANY("low", w)
_GAPS = [
    ("code_examples = 0", "code-examples"),
    (f"NOT {_HAS(*K.PRODUCTION_WORDS)} AND category = 'deployment'", "production-guidance"),
    (f"NOT {_HAS('error', 'troubleshoot')}", "error-handling"),
    (f"category = 'email-delivery' AND NOT {_HAS('spam', 'deliverability')}", "spam-handling"),
    (f"category = 'email-delivery' AND NOT {_HAS('dns', 'spf', 'dkim')}", "dns-setup"),
    (f"category = 'deployment' AND NOT {_HAS('vercel', 'netlify')} AND contains(lower(title), 'vercel')", "platform-deployment"),
    (f"category = 'deployment' AND NOT {_HAS('environment variable', 'env')}", "environment-setup"),
]
EVID = f"""(SELECT issue_id, page_id, similarity, len(list_filter(keywords, lambda w: contains(low, w))) >= 2 AS relevant, code_examples, {_HAS(*K.PRODUCTION_WORDS)} AS production_guidance, page_title,
  list_filter([{', '.join(f"CASE WHEN {c} THEN '{g}' END" for c, g in _GAPS)}], lambda g: g IS NOT NULL) AS gaps
  FROM (SELECT x.issue_id, x.page_id, similarity, title, category, keywords, {PQ.TITLE} AS page_title, lower(html) AS low, {D.nmatch('html', '(?i)<code|<pre|```')} AS code_examples
    FROM {PAIRS} x JOIN {KEYS} k ON k.issue_id = x.issue_id JOIN {AP} p ON p.page_id = x.page_id WHERE x.page_id % 13 <> 5))"""
QUERIES["i9_page_evidence"] = lambda spark, sf: _evidence(spark, sf).filter("loaded").drop("loaded").withColumn("gaps", F.array_join("gaps", "|"))
ORACLE["i9_page_evidence"] = f"SELECT * REPLACE (array_to_string(gaps, '|') AS gaps) FROM {EVID}"


def _status(spark, sf):
    issues = settled(keyed(spark, sf))
    return I.issue_status(issues, _evidence(spark, sf, issues))


QUERIES["i10_issue_status"] = _status
STATUS = f"""(SELECT k.issue_id, CASE WHEN n IS NULL THEN 'critical-gap' WHEN complete THEN 'resolved' WHEN near THEN 'potential-gap' WHEN rel THEN 'confirmed' ELSE 'critical-gap' END AS status,
  CAST(CASE WHEN n IS NULL THEN 95 WHEN complete THEN 90 WHEN near THEN 75 WHEN rel THEN 70 ELSE 85 END AS BIGINT) AS confidence FROM {KEYS} k
  LEFT JOIN (SELECT issue_id, count(*) AS n FROM {PAIRS} GROUP BY issue_id) p ON p.issue_id = k.issue_id
  LEFT JOIN (SELECT issue_id, bool_or(relevant AND len(gaps) = 0 AND coalesce(similarity, 0) > 0.85) AS complete, bool_or(coalesce(similarity, 0) > 0.6) AS near, bool_or(relevant) AS rel FROM {EVID} GROUP BY issue_id) e ON e.issue_id = k.issue_id)"""
ORACLE["i10_issue_status"] = f"SELECT * FROM {STATUS}"
QUERIES["i11_best_match"] = lambda spark, sf: I.best_match(_evidence(spark, sf))
ORACLE["i11_best_match"] = f"""SELECT issue_id, page_id, s AS similarity, CASE WHEN s < 0.5 THEN 'generic' ELSE 'detailed' END AS advice FROM (
  SELECT *, coalesce(similarity, 0) AS s, row_number() OVER (PARTITION BY issue_id ORDER BY coalesce(similarity, 0) DESC, page_id) AS n FROM {EVID}) WHERE n = 1"""
QUERIES["i12_status_summary"] = lambda spark, sf: I.status_summary(_status(spark, sf))
ORACLE["i12_status_summary"] = f"""SELECT count(*) AS total, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'resolved') AS resolved,
  count(*) FILTER (status = 'potential-gap') AS potential_gaps, count(*) FILTER (status = 'critical-gap') AS critical_gaps FROM {STATUS}"""

_CAT = lambda x: "CASE " + " ".join(f"WHEN {_ANY(x, w)} THEN '{n}'" for n, w in K.ISSUE_CATEGORIES) + " ELSE 'general' END"
QUERIES["i13_categorize"] = lambda spark, sf: issues(spark, sf).select("number", I.categorize(F.concat_ws(" ", "title", "body")).alias("category"))
ORACLE["i13_categorize"] = f"SELECT number, {_CAT('t')} AS category FROM (SELECT number, lower(concat_ws(' ', title, body)) AS t FROM {ISS})"

_CUTTEXT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {D.trim(f'left({x}, {n})')} || '...' END"
QS = f"""(SELECT 'stackoverflow-' || question_id AS id, {_CUTTEXT('title', 80)} AS title, {_CAT('lower(title)')} AS category, {_CUTTEXT('title', 120)} AS description,
  CAST(least(floor(coalesce(view_count, 0) / 100), 50) AS BIGINT) AS frequency, CASE WHEN score > 5 THEN 'high' WHEN score > 2 THEN 'medium' ELSE 'low' END AS severity, company, last_seen FROM {QUE})"""


def _questions(spark, sf):
    q = spark_table(spark, sf, "questions")
    keys = q.select(F.concat(F.lit("stackoverflow-"), "question_id").alias("id"), "company", "last_seen")
    return I.from_question_stats(q).join(keys, "id")


QUERIES["i14_rank_issues"] = lambda spark, sf: I.rank_issues(_questions(spark, sf)).select("company", F.col("rank").cast("long").alias("rank"), "id", "frequency")
ORACLE["i14_rank_issues"] = f"""SELECT company, rank, id, frequency FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY frequency DESC, last_seen DESC, id) AS rank FROM {QS}) WHERE rank <= 10"""
QUERIES["i15_from_question_stats"] = lambda spark, sf: I.from_question_stats(spark_table(spark, sf, "questions"))
ORACLE["i15_from_question_stats"] = f"SELECT id, title, category, description, frequency, severity FROM {QS}"

_DOM = "CASE k % 4 WHEN 0 THEN 'docs.knock.app' WHEN 1 THEN 'resend.com' WHEN 2 THEN 'other.dev' ELSE 'Knock.app' END"


def _i16(spark, sf):
    own = _questions(spark, sf)
    cust = spark_table(spark, sf, "customer").select(F.concat(F.lit("company"), "c_custkey").alias("company"), F.expr(_DOM.replace("k %", "c_custkey %")).alias("domain"))
    return I.add_audits(own, cust, F.expr("DATE '2024-02-01'")).withColumn("last_seen", F.col("last_seen").cast("string"))


QUERIES["i16_add_audits"] = _i16
_AUD = ", ".join(f"('{k}', '{i}', '{t}', '{c}', {f}, '{s}')" for k, i, t, c, f, s in K.PROACTIVE_AUDITS)
ORACLE["i16_add_audits"] = f"""WITH own AS (SELECT * FROM {QS}), n AS (SELECT company, count(*) AS n FROM own GROUP BY company),
a(kind, id, title, category, frequency, severity) AS (VALUES {_AUD})
SELECT company, id, title, category, frequency, severity, CAST(last_seen AS VARCHAR) AS last_seen FROM own
UNION ALL SELECT c.company, a.id, a.title, a.category, CAST(a.frequency AS BIGINT), a.severity, '2024-02-01' FROM (SELECT 'company' || c_custkey AS company, lower({_DOM.replace('k %', 'c_custkey %')}) AS d FROM customer) c
  LEFT JOIN n ON n.company = c.company JOIN a ON a.kind = CASE WHEN contains(d, 'knock.app') THEN 'notification-api' WHEN contains(d, 'resend.com') THEN 'email-api' END WHERE coalesce(n.n, 0) < 4"""

QUERIES["i17_docs_repo_candidates"] = lambda spark, sf: I.docs_repo_candidates(
    spark_table(spark, sf, "repos").withColumn("topics", F.split("topic_text", ";")), spark_table(spark, sf, "repo_files")
)
ORACLE["i17_docs_repo_candidates"] = rf"""WITH c AS (SELECT * FROM (SELECT owner, name, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, name) AS rank FROM {REPOS}
  WHERE NOT is_current AND (regexp_matches(name, '{K.DOCS_REPO_NAME_PATTERN}') OR regexp_matches(coalesce(description, ''), '{K.DOCS_REPO_DESC_PATTERN}') OR len(list_filter(string_split(topic_text, ';'), lambda t: regexp_matches(t, '{K.DOCS_REPO_TOPIC_PATTERN}'))) > 0))),
f AS (SELECT owner, repo, bool_or(type = 'file' AND lower(path) = 'llms.txt') AS ll, count(*) FILTER (type = 'file' AND NOT contains(path, '/') AND regexp_matches(path, '{K.CODE_FILE_PATTERN}')) AS code,
  count(*) FILTER (type = 'file' AND regexp_matches(lower(path), '\.mdx?$') AND ((NOT contains(path, '/') AND lower(path) NOT IN ({D.q(K.BOILERPLATE_FILES)})) OR (len(string_split(path, '/')) = 2 AND lower(split_part(path, '/', 1)) IN ({D.q(K.CONTENT_FOLDERS)})))) AS md FROM {FILES} GROUP BY owner, repo)
SELECT c.owner, c.name, rank, coalesce(ll, false) AS has_llms_txt, coalesce(ll, false) OR coalesce(md, 0) >= 5 AS has_docs_content, CASE WHEN ll THEN -1 ELSE coalesce(md, 0) END AS content_files, coalesce(code, 0) AS code_files
FROM c LEFT JOIN f ON f.owner = c.owner AND f.repo = c.name"""


def _i18(spark, sf):
    rows = _status(spark, sf).select(F.concat(F.lit("s"), (F.col("issue_id") % 60).cast("string")).alias("session_id"), F.col("issue_id").alias("pos"), "confidence")
    return I.rank_gaps(rows).select("session_id", "pos", "confidence", F.col("rank").cast("long").alias("rank"))


QUERIES["i18_rank_gaps"] = _i18
ORACLE["i18_rank_gaps"] = f"""SELECT session_id, pos, confidence, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, pos) AS rank FROM (
  SELECT 's' || (issue_id % 60) AS session_id, issue_id AS pos, confidence, 1 AS n FROM {STATUS})"""


def _i19(spark, sf):
    dev = issues(spark, sf).select("number", "title", F.array(F.concat(F.lit("https://forum.example.com/q/"), F.col("number") * 2)).alias("sources"))
    posts = spark_table(spark, sf, "posts").select(F.concat(F.lit("https://forum.example.com/q/"), "doc_id").alias("url"), "html")
    e = I.enrich(dev, posts)
    return e.select("number", "title", "full_content", *[F.array_join(x, "|").alias(x) for x in ("code_snippets", "error_messages", "tags")], "stack_trace")


QUERIES["i19_enrich"] = _i19
_BODY = D.squash(PQ.strip("""array_to_string(regexp_extract_all(html, '(?is)<div class="s-prose js-post-body"[^>]*itemprop="text">(.*?)</div>\\s*</div>', 1)[1:3], '')""", " "))
ORACLE["i19_enrich"] = f"""SELECT i.number, i.title, {_BODY} AS full_content, fenced AS code_snippets, errors AS error_messages, replace(tags, ',', '|') AS tags, stack_trace
  FROM {ISS} i LEFT JOIN (SELECT p.doc_id, p.html, s.fenced, f.errors, f.tags, f.stack_trace FROM {PQ.POSTS} p JOIN ({PQ.ORACLE['h20_post_snippets']}) s ON s.doc_id = p.doc_id JOIN ({PQ.ORACLE['h28_post_fields']}) f ON f.doc_id = p.doc_id) x ON x.doc_id = i.number * 2"""


def _repo_docs(spark, sf):
    d = spark_table(spark, sf, "documents")
    # documents of a repository: a language shelf of the issue numbers' cycle
    return d.select("doc_id", F.concat(F.lit("repo"), (F.col("doc_id") % 7).cast("string")).alias("repo"), F.col("text").alias("content"))


QUERIES["i20_relevant_docs"] = lambda spark, sf: I.relevant_docs(issues(spark, sf), _repo_docs(spark, sf))
_I20W = "list_filter(string_split_regex(lower(title || ' ' || coalesce(body, '')), '\\s+'), lambda w: length(w) > 4)"
REL = f"""(SELECT number, doc_id, CAST(n AS BIGINT) AS matches FROM (SELECT number, doc_id, len(list_filter(w, lambda x: contains(c, x))) AS n FROM (SELECT number, repo, {_I20W} AS w FROM {ISS}) i
  JOIN (SELECT doc_id, 'repo' || (doc_id % 7) AS repo, lower(text) AS c FROM documents) d ON d.repo = i.repo) WHERE n > 3)"""
ORACLE["i20_relevant_docs"] = f"SELECT * FROM {REL}"
QUERIES["i20_local_ranking"] = lambda spark, sf: I.local_ranking(issues(spark, sf), QUERIES["i20_relevant_docs"](spark, sf))
ORACLE["i20_local_ranking"] = f"""SELECT i.number, {_ANY('''lower(title || ' ' || coalesce(body, ''))''', K.LOCAL_DOCS_SIGNALS)} OR len(list_filter(string_split(lower(label_text), ';'), lambda l: l IN ({D.q(K.LOCAL_DOCS_LABELS)}))) > 0 OR n IS NOT NULL AS likely_docs,
  coalesce(n, 0) AS relevant_docs, reactions FROM {ISS} i LEFT JOIN (SELECT number, count(*) AS n FROM {REL} GROUP BY number) r ON r.number = i.number"""


def _i21(spark, sf):
    pages = spark_table(spark, sf, "audit_pages").select(U.host("url").alias("site"), "url", "page_id", H.visible_text("html", "crawl").alias("content"))
    picked = pages.filter("page_id % 4 = 1").select("site", "url")
    failed = pages.filter("length(site) % 3 = 0").select("site").distinct()
    fallback = pages.filter("page_id % 3 = 0").select("site", "url")
    return I.select_docs_pages(pages.drop("page_id"), picked, failed, fallback).select("site", "url", F.length("content").cast("long").alias("chars"))


QUERIES["i21_select_docs_pages"] = _i21
_CRAWL = D.squash(PQ.strip(PQ.drop("html", ["script", "style", "nav", "footer", "header"]), " "))
ORACLE["i21_select_docs_pages"] = f"""WITH p AS (SELECT page_id, {D.host('url')} AS site, url, {_CRAWL} AS c FROM {AP}), u AS (SELECT *, CASE WHEN length(site) % 3 = 0 THEN page_id % 3 = 0 ELSE page_id % 4 = 1 END AS pick FROM p WHERE length(c) > 100),
  s AS (SELECT site, count(*) AS n, bool_or(pick) AS anyp FROM u GROUP BY site)
SELECT u.site, url, CAST(length(c) AS BIGINT) AS chars FROM u JOIN s ON s.site = u.site WHERE NOT (n > 10 AND anyp) OR pick"""


def _i22(spark, sf):
    e = QUERIES["i19_enrich"](spark, sf)
    arrays = {x: F.split(F.nullif(x, F.lit("")), "\\|") for x in ("code_snippets", "error_messages", "tags")}
    j = e.join(issues(spark, sf).select("number", F.col("body").alias("description"), "category"), "number").withColumns(arrays)
    return j.select("number", I.issue_embedding_text(j).alias("text"))


QUERIES["i22_issue_embedding_text"] = _i22
ORACLE["i22_issue_embedding_text"] = f"""SELECT e.number, concat_ws(' ', e.title, i.body, i.category, nullif(full_content, ''), nullif(replace(code_snippets, '|', ' '), ''), nullif(replace(error_messages, '|', ' '), ''), nullif(replace(tags, '|', ' '), ''), nullif(stack_trace, '')) AS text
  FROM ({ORACLE['i19_enrich']}) e JOIN {ISS} i ON i.number = e.number"""
QUERIES["i22_page_embedding_text"] = lambda spark, sf: spark_table(spark, sf, "audit_pages").select(
    "page_id", I.page_embedding_text(H.title("html"), H.meta_description("html"), H.visible_text("html", "embed")).alias("text")
)
_ET = f"CASE WHEN length({PQ.EMBED_TEXT}) > 8000 THEN left({PQ.EMBED_TEXT}, 8000) || '...' ELSE {PQ.EMBED_TEXT} END"
ORACLE["i22_page_embedding_text"] = f"""SELECT page_id, CASE WHEN length(t) >= 10 THEN t END AS text FROM (SELECT page_id, {D.trim(f"concat_ws(' ', {PQ.TITLE}, {PQ.META_D}, {_ET})")} AS t FROM {AP})"""
