"""Registered queries over sources, stores, model text, fixes and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import urls as U
from doccensus.functions.common import shared_folder
from doccensus.operators import fixes as X
from doccensus.operators import usage as O
from doccensus.plans import issues_queries as IQ
from doccensus.plans import oracle_frag as D
from doccensus.plans import pages_queries as PQ
from doccensus.plans import scoring_queries as SC
from doccensus.plans import urls_queries as UQ
from doccensus.plans.inputs import oracle_table, spark_table
from doccensus.sources import model_io as M
from doccensus.sources import readers as RD
from doccensus.sources import stores as ST

QUERIES: dict = {}
ORACLE: dict = {}
AP, ISS, KBV, REQ, FIX, USE, SIGN, ACC, AUD, PRO, DIMS, FIND, MD = (
    oracle_table(x)
    for x in ("audit_pages", "issues", "kb_versions", "cache_requests", "fixes", "usage_events", "signups", "access_events", "audit_log", "progress_events", "dimension_results", "findings", "markdown_docs")
)
NOW = "TIMESTAMP '2024-01-15 00:00:00'"
_KBD = lambda u: f"replace({D.root2(D.nowww(D.host(u)))}, '.', '-')"

# ── sources and stores ──────────────────────────────────────────────────

_FINAL = "CASE WHEN page_id % 3 = 0 THEN concat(url, '/moved') ELSE NULL END"
QUERIES["s1_read_pages"] = lambda spark, sf: RD.settle_redirects(spark_table(spark, sf, "pages").withColumn("final_url", F.expr(_FINAL))).select("page_id", "url", F.length("html").cast("long").alias("chars"))
ORACLE["s1_read_pages"] = f"SELECT page_id, coalesce({_FINAL}, url) AS url, CAST(length(html) AS BIGINT) AS chars FROM pages"

def _s2(spark, sf):
    """Site files written as a crawler leaves them, and read by kind."""
    path = shared_folder(spark, "site-files")
    rows = spark_table(spark, sf, "site_robots").select(
        "base_url", "body", F.lit("robots").alias("kind"), F.when(F.col("body").isNull(), 404).otherwise(200).alias("status_code")
    )
    rows.unionByName(rows.withColumn("kind", F.lit("llms"))).write.partitionBy("kind").parquet(path)
    return RD.read_site_files(spark, path, "robots").select("base_url", F.length("body").cast("long").alias("chars"))


QUERIES["s2_site_files"] = _s2
ORACLE["s2_site_files"] = f"SELECT base_url, CAST(length(body) AS BIGINT) AS chars FROM {oracle_table('site_robots')} WHERE body IS NOT NULL"
def _s3(spark, sf):
    path = shared_folder(spark, "fetch-log")
    spark_table(spark, sf, "fetch_log").withColumn("status_code", F.col("status_code").cast("int")).write.parquet(path)
    return RD.read_fetch_log(spark, path).groupBy("purpose", "status_code").agg(F.count("*").alias("n"))


QUERIES["s3_fetch_log"] = _s3
ORACLE["s3_fetch_log"] = f"SELECT purpose, status_code, count(*) AS n FROM {oracle_table('fetch_log')} GROUP BY ALL"


def _issue_lines(spark, sf):
    """The issues as the JSON documents an issue tracker returns."""
    i = IQ.issues(spark, sf)
    pull = F.when(F.col("number") % 11 == 0, F.struct(F.lit("https://x/pull").alias("url")))
    comments = F.when(F.col("comments") > 0, F.col("comments"))
    row = F.struct(
        "number", "title", "body", F.concat(F.lit("https://x/"), "number").alias("html_url"), F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("labels"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), comments.alias("comments"),
        F.when(F.col("reactions") > 0, F.struct(F.col("reactions").alias("total_count"))).alias("reactions"), "state", pull.alias("pull_request"),
    )
    return i.select(F.to_json(row).alias("value"))


QUERIES["s4_read_issues"] = lambda spark, sf: RD.parse_issue_lines(_issue_lines(spark, sf)).select(
    "number", "title", "body", F.array_join("labels", ";").alias("labels"), F.col("created_at").cast("string").alias("created_at"), F.col("comments").cast("long").alias("comments"), F.col("reactions").cast("long").alias("reactions"), "state"
)
ORACLE["s4_read_issues"] = f"""SELECT number, title, coalesce(body, '') AS body, label_text AS labels, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, comments, reactions, state FROM {ISS} WHERE number % 11 <> 0"""


def _s5(spark, sf):
    """Curated files: each holds one company's list and a metadata object."""
    q = IQ._questions(spark, sf)
    item = F.struct("id", "title", "category", F.col("frequency").cast("int").alias("frequency"), F.col("last_seen").cast("string").alias("lastSeen"), "severity", F.array(F.concat(F.lit("/docs/"), "id")).alias("relatedPages"))
    text = F.concat(F.lit('{"'), "company", F.lit('": ['), F.to_json(item), F.lit('], "metadata": {"total": 1}}'))
    rows = RD.parse_curated_issues(q.select(text.alias("value")))
    asked = spark_table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(
        RD.company_key(F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('Company', c_custkey) END"), F.concat(F.lit("Company"), "c_custkey", F.lit(".dev"))).alias("company")
    )
    return rows.join(asked, "company", "left_semi").select("company", "id", "frequency", F.col("lastSeen").cast("string").alias("last_seen"), F.get("relatedPages", F.lit(0)).alias("page"))


QUERIES["s5_read_curated_issues"] = _s5
ORACLE["s5_read_curated_issues"] = f"""SELECT company, id, CAST(frequency AS INTEGER) AS frequency, CAST(last_seen AS VARCHAR) AS last_seen, '/docs/' || id AS page FROM {IQ.QS}
  WHERE company IN (SELECT 'company' || c_custkey FROM customer WHERE c_custkey % 2 = 0)"""

QUERIES["s6_read_embeddings"] = lambda spark, sf: RD.read_embeddings(spark, f"{sf}/embeddings.parquet").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))
ORACLE["s6_read_embeddings"] = "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE))), 4) AS norm2 FROM embeddings"


def _kb_split(spark, sf):
    v = spark_table(spark, sf, "kb_versions")
    old = v.filter("version = 0").drop("version", "page_id").withColumn("domain", U.kb_domain("url")).withColumn("expires_at", F.col("crawled_at") + F.make_dt_interval(F.lit(7)))
    return old, v.filter("version = 1").drop("version", "page_id")


def _s7(spark, sf):
    path = shared_folder(spark, "kb")
    ST.write_kb(_kb_split(spark, sf)[0], path)
    return ST.read_kb(spark, path, "example-net", F.expr(NOW)).select("url", "title", F.col("expires_at").cast("string").alias("expires_at"))


QUERIES["s7_read_kb"] = _s7
ORACLE["s7_read_kb"] = f"SELECT url, title, CAST(crawled_at + INTERVAL 7 DAY AS VARCHAR) AS expires_at FROM {KBV} WHERE version = 0 AND {_KBD('url')} = 'example-net' AND crawled_at + INTERVAL 7 DAY > {NOW}"


def _s8(spark, sf):
    old, new = _kb_split(spark, sf)
    return ST.upsert_kb(old, new, F.expr(NOW)).select("domain", "url", "title", "source", F.col("crawled_at").cast("string").alias("crawled_at"), F.col("expires_at").cast("string").alias("expires_at"))


QUERIES["s8_upsert_kb"] = _s8
ORACLE["s8_upsert_kb"] = f"""SELECT {_KBD('url')} AS domain, url, title, source, CAST(crawled_at AS VARCHAR) AS crawled_at, CAST(e AS VARCHAR) AS expires_at FROM (
  SELECT *, CASE WHEN version = 1 THEN {NOW} + INTERVAL 7 DAY ELSE crawled_at + INTERVAL 7 DAY END AS e, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, version DESC) AS n FROM {KBV}) WHERE n = 1"""


def _s9(spark, sf):
    pages = spark_table(spark, sf, "audit_pages")
    cache = pages.filter("page_id % 3 <> 1").select(U.normalize_url("url").alias("url"), F.lit("with-context").alias("contextual_setting"), F.expr(f"{NOW} + INTERVAL '1' DAY * CAST(page_id % 5 - 2 AS INT)").alias("ttl"))
    return ST.split_cached(spark_table(spark, sf, "cache_requests"), cache, F.expr(NOW)).select("event_id", "cache_url", "cache_status")


QUERIES["s9_split_cached"] = _s9
ORACLE["s9_split_cached"] = f"""WITH c AS (SELECT DISTINCT {UQ._NORM} AS k FROM {AP} WHERE page_id % 3 <> 1 AND page_id % 5 - 2 >= 0), n AS (SELECT url, {UQ._NORM} AS k FROM {AP})
SELECT event_id, n.k AS cache_url, CASE WHEN contextual_setting = 'with-context' AND n.k IN (SELECT k FROM c) THEN 'hit' ELSE 'miss' END AS cache_status FROM {REQ} r JOIN n ON n.url = r.url"""


def _s9_at(spark, sf):
    v = spark_table(spark, sf, "cache_versions").withColumn("url", U.normalize_url("url"))
    return ST.split_cached_at(spark_table(spark, sf, "timed_requests"), v).select("event_id", "cache_url", "cache_status")


QUERIES["s9_split_cached_at_request"] = _s9_at
ORACLE["s9_split_cached_at_request"] = f"""WITH r AS (SELECT *, {UQ._NORM} AS k FROM {oracle_table('timed_requests')}),
v AS (SELECT {UQ._NORM} AS k, contextual_setting, CAST(processed_at AS TIMESTAMP) AS made, max(CAST(ttl AS TIMESTAMP)) AS ttl FROM {oracle_table('cache_versions')} GROUP BY ALL)
SELECT event_id, r.k AS cache_url, CASE WHEN v.ttl >= r.ts THEN 'hit' ELSE 'miss' END AS cache_status
FROM r ASOF LEFT JOIN v ON v.k = r.k AND v.contextual_setting = r.contextual_setting AND r.ts >= v.made"""


def _s10(spark, sf):
    d = spark_table(spark, sf, "markdown_docs").select("doc_id", "url", F.lit("with-context").alias("contextual_setting"), F.col("md").alias("markdown"), F.lit("mixed").alias("content_type"))
    path = shared_folder(spark, "cache")
    ST.write_cache(d, path, F.expr(NOW))
    return spark.read.parquet(path).select("url", "content_hash", "location", F.col("ttl").cast("string").alias("ttl"))


QUERIES["s10_write_cache"] = _s10
ORACLE["s10_write_cache"] = f"""SELECT url, sha256(md) AS content_hash, 'sessions/session-' || left(sha256(url || '#with-context'), 12) || '/processed-content.json' AS location, '2024-01-22 00:00:00' AS ttl FROM {MD}"""

def _s11(spark, sf):
    """The nested report written as JSON documents and read back."""
    path = shared_folder(spark, "report")
    ST.write_report(SC._g18(spark, sf), path)
    shape = "page_id long, overall long, grade string, recommendations array<struct<position:long>>"
    return spark.read.schema(shape).json(path).select("page_id", "overall", "grade", F.coalesce(F.size("recommendations"), F.lit(0)).cast("long").alias("recommendations"))


QUERIES["s11_write_report"] = _s11
ORACLE["s11_write_report"] = f"""SELECT s.page_id, s.overall, {SC.GRADE} AS grade, coalesce(n, 0) AS recommendations FROM {SC.SCORES} s
  LEFT JOIN (SELECT page_id, count(*) AS n FROM ({SC.ORACLE["g5_merge_recommendations"]}) GROUP BY page_id) r ON r.page_id = s.page_id"""

_ANSWER = """CASE doc_id % 6 WHEN 0 THEN concat('```json', chr(10), '{"score": ', CAST(doc_id % 100 AS STRING), ', "tags": ["a", "b"]}', chr(10), '```')
  WHEN 1 THEN concat('{"score": ', CAST(doc_id % 100 AS STRING), '}') WHEN 2 THEN concat('Sure! {"score": ', CAST(doc_id % 100 AS STRING), ', "note": "x {y} z"} hope it helps')
  WHEN 3 THEN 'no json at all' WHEN 4 THEN '```{"score": 1' ELSE concat('Broken {"score": 2 ', source) END"""


def _s12(spark, sf):
    d = spark_table(spark, sf, "documents").withColumn("answer", F.expr(_ANSWER))
    parsed = d.select("doc_id", M.parse_model_json("answer", "score BIGINT, tags ARRAY<STRING>, note STRING").alias("p"), M.json_text("answer").alias("t"))
    return parsed.select("doc_id", F.col("t").isNotNull().alias("found"), F.col("p.score").alias("score"), F.array_join("p.tags", ",").alias("tags"), F.col("p.note").alias("note"))


QUERIES["s12_parse_model_json"] = _s12
ORACLE["s12_parse_model_json"] = f"""SELECT doc_id, doc_id % 6 <= 2 AS found, CASE WHEN doc_id % 6 <= 2 THEN doc_id % 100 END AS score, CASE WHEN doc_id % 6 = 0 THEN 'a,b' END AS tags, CASE WHEN doc_id % 6 = 2 THEN 'x {{y}} z' END AS note FROM documents"""

_SUMMARY = """concat(CASE doc_id % 4 WHEN 0 THEN 'DOC TYPE: Tutorial' WHEN 1 THEN 'DOC TYPE: poem' ELSE 'Intro line' END, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('TOPIC: About ', lang, ' things ', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 < 2 THEN concat('KEY TERMS: alpha, ', source, ' ,, beta', chr(10)) ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN concat('COVERS:', chr(10), '- first thing', chr(10), '*  second', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN concat('CODE EXAMPLES: one', chr(10)) ELSE '' END, CASE WHEN doc_id % 6 = 0 THEN 'LIMITATIONS: slow' ELSE '' END)"""


def _s13(spark, sf):
    d = spark_table(spark, sf, "documents").select("doc_id", F.expr(_SUMMARY).alias("s"), F.concat(F.lit("T"), "doc_id").alias("title"))
    f = M.summary_fields("s", "title")
    f["key_terms"], f["covers"] = F.array_join(f["key_terms"], "|"), F.array_join(f["covers"], "|")
    return d.select("doc_id", *[v.alias(k) for k, v in f.items()])


QUERIES["s13_parse_summary_fields"] = _s13
ORACLE["s13_parse_summary_fields"] = f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'tutorial' END AS documentation_type, CASE WHEN doc_id % 3 = 0 THEN 'About ' || lang || ' things' ELSE 'Documentation page: T' || doc_id END AS topic,
  CASE WHEN doc_id % 5 < 2 THEN 'alpha|' || source || '|beta' ELSE 'T' || doc_id END AS key_terms, CASE WHEN doc_id % 2 = 0 THEN 'first thing|second' ELSE 'Content about T' || doc_id END AS covers,
  CASE WHEN doc_id % 7 = 0 THEN 'one' ELSE 'None' END AS code_examples, CASE WHEN doc_id % 6 = 0 THEN 'slow' ELSE 'None noted' END AS limitations FROM documents"""


def _s14(spark, sf):
    d = spark_table(spark, sf, "documents")
    r = M.model_requests(d, spark_table(spark, sf, "labels"), "doc_id", "text", "issue")
    return r.select("doc_id", "kind", F.md5("input").alias("digest"), F.length("input").cast("long").alias("chars"))


QUERIES["s14_model_requests"] = _s14
ORACLE["s14_model_requests"] = "SELECT doc_id, 'issue' AS kind, md5(left(text, 3000)) AS digest, CAST(least(length(text), 3000) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

# ── fixes ───────────────────────────────────────────────────────────────


def _x1(spark, sf):
    f = spark_table(spark, sf, "findings").select("page", "finding")
    actions = spark_table(spark, sf, "dimension_results").select("page", F.concat(F.lit("Improve "), "dimension").alias("action"))
    selected = spark_table(spark, sf, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("page"), F.concat(F.lit("Picked "), "lang").alias("text"))
    return X.issues_to_fix(f, actions, selected)


QUERIES["x1_issues_to_fix"] = _x1
ORACLE["x1_issues_to_fix"] = f"""SELECT doc_id AS page, 'Picked ' || lang AS text FROM documents WHERE doc_id % 5 = 0
UNION ALL (SELECT page, finding FROM {FIND} WHERE page % 5 <> 0 UNION SELECT page, 'Improve ' || dimension FROM {DIMS} WHERE page % 5 <> 0)"""


def _docs(spark, sf):
    return spark_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))


def _x2(spark, sf):
    fixes = spark_table(spark, sf, "fixes")
    out = X.apply_fixes(_docs(spark, sf), fixes, fixes.filter("confidence >= 20").select("fix_id"))
    told = F.transform("outcomes", lambda o: F.concat_ws(":", o["fix_id"], F.coalesce(o["strategy"], F.lit("-"))))
    return out.select("doc_id", F.md5("content").alias("digest"), F.size(F.filter("outcomes", lambda o: o["applied"])).cast("long").alias("applied"), F.array_join(told, "|").alias("outcomes"))


QUERIES["x2_apply_fixes"] = _x2
_SPL = lambda t, o, n: f"CASE WHEN instr({t}, {o}) > 0 THEN left({t}, instr({t}, {o}) - 1) || {n} || substring({t}, instr({t}, {o}) + length({o})) ELSE {t} END"
_FIXES = range(4)  # fixes of a document in the derived table


def _x2_oracle() -> str:
    """The fold unrolled: one step of the three strategies for each of the four fixes."""
    quoted = lambda words, gap: f"array_to_string(list_transform({words}, lambda w: '\\Q' || w || '\\E'), '{gap}')"
    words = "list_filter(string_split_regex(trim(o{0}), '\\s+'), lambda w: w <> '')"
    text = f"SELECT d.doc_id, text AS t, '' AS told, 0 AS applied, f.* EXCLUDE (doc_id) FROM documents d JOIN (SELECT doc_id, " + ", ".join(
        f"max(fix_id) FILTER (pos = {k}) AS f{k}, max(original) FILTER (pos = {k}) AS o{k}, max(proposed) FILTER (pos = {k}) AS p{k}" for k in _FIXES
    ) + f" FROM {FIX} WHERE confidence >= 20 GROUP BY doc_id) f ON f.doc_id = d.doc_id"
    for k in _FIXES:
        w = words.format(k)
        long = f"list_filter({w}, lambda w: length(w) > 2)"
        hits = f"""SELECT *, CASE WHEN f{k} IS NULL THEN NULL WHEN contains(t, o{k}) THEN o{k} END AS h1,
          CASE WHEN f{k} IS NOT NULL THEN nullif(regexp_extract(t, {quoted(w, chr(92) + 's+')}), '') END AS h2,
          CASE WHEN f{k} IS NOT NULL AND len({long}) > 2 THEN nullif(regexp_extract(t, '(?s)' || {quoted(long, '.{0,50}?')}), '') END AS h3 FROM ({text})"""
        text = f"""SELECT * EXCLUDE (t, told, applied, h1, h2, h3), CASE WHEN coalesce(h1, h2, h3) IS NULL THEN t ELSE {_SPL('t', 'coalesce(h1, h2, h3)', f'p{k}')} END AS t,
          CASE WHEN f{k} IS NULL THEN told ELSE told || CASE WHEN told = '' THEN '' ELSE '|' END || f{k} || ':' || CASE WHEN h1 IS NOT NULL THEN 'exact' WHEN h2 IS NOT NULL THEN 'whitespace' WHEN h3 IS NOT NULL THEN 'tokens' ELSE '-' END END AS told,
          applied + CAST(coalesce(h1, h2, h3) IS NOT NULL AS INTEGER) AS applied FROM ({hits})"""
    return f"SELECT doc_id, md5(t) AS digest, CAST(applied AS BIGINT) AS applied, told AS outcomes FROM ({text})"


ORACLE["x2_apply_fixes"] = _x2_oracle()
QUERIES["x2_apply_exact"] = lambda spark, sf: X.apply_exact_fixes(_docs(spark, sf), spark_table(spark, sf, "fixes"))
_EXACT = "text"
for _k in _FIXES:
    _EXACT = f"(SELECT {_SPL('t', f'o{_k}', f'p{_k}')} FROM (SELECT {_EXACT} AS t))"
ORACLE["x2_apply_exact"] = f"""WITH f AS (SELECT doc_id, {', '.join(f'max(original) FILTER (pos = {k}) AS o{k}, max(proposed) FILTER (pos = {k}) AS p{k}' for k in _FIXES)} FROM {FIX} GROUP BY doc_id)
SELECT doc_id, {_EXACT} AS content FROM documents JOIN f USING (doc_id)"""

_CLDOC = "CASE doc_id % 3 WHEN 0 THEN concat('Top', chr(10), '##  changelog', chr(10), text, '## Changelog') WHEN 1 THEN concat(text, chr(10), '## SUPPORT here') ELSE text END"


def _x3(spark, sf):
    d = spark_table(spark, sf, "documents").select("doc_id", F.expr(_CLDOC).alias("content"))
    return X.add_changelog(d, spark_table(spark, sf, "fixes").filter("confidence > 50"), F.lit("2024-01-15"))


QUERIES["x3_add_changelog"] = _x3
ORACLE["x3_add_changelog"] = f"""WITH a AS (SELECT doc_id, '## Changelog' || chr(10) || chr(10) || '### [2024-01-15] - AI Update' || chr(10) || '- ' || count(*) || ' fixes applied:' || chr(10) || string_agg('  - ' || category || ': ' || rationale, chr(10) ORDER BY pos) || chr(10) AS e FROM {FIX} WHERE confidence > 50 GROUP BY doc_id),
d AS (SELECT d.doc_id, {_CLDOC.replace('doc_id', 'd.doc_id')} AS t, e FROM documents d JOIN a ON a.doc_id = d.doc_id), m AS (SELECT *, regexp_extract(t, '(?i)##\\s+Changelog') AS cl, regexp_extract(t, '(?i)##\\s+Support') AS su FROM d)
SELECT doc_id, CASE WHEN cl <> '' THEN {_SPL('t', 'cl', 'e')} WHEN su <> '' THEN {_SPL('t', 'su', "(e || chr(10) || '---' || chr(10) || chr(10) || '## Support')")} ELSE t || chr(10) || chr(10) || '---' || chr(10) || chr(10) || e END AS content FROM m"""

QUERIES["x4_fix_summary"] = lambda spark, sf: X.fix_summary(spark_table(spark, sf, "fixes"))
ORACLE["x4_fix_summary"] = f"SELECT session_id, count(*) AS total, {', '.join(f'''count(*) FILTER (category = '{c}') AS {c.lower()}''' for c in K.FIX_CATEGORIES)}, {D.rnd('avg(confidence)')} AS mean_confidence FROM {FIX} GROUP BY session_id"

_OLD = "CASE doc_id % 4 WHEN 0 THEN substring(text, 10, 12) WHEN 1 THEN 'absent text here' WHEN 2 THEN NULL ELSE substring(text, 3, 5) END"
_FILE = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END"
QUERIES["x5_patch_file"] = lambda spark, sf: spark_table(spark, sf, "documents").select("doc_id", X.patch_file(F.expr(_FILE), F.expr(_OLD), F.concat(F.lit("NEW $& "), "doc_id")).alias("content"))
ORACLE["x5_patch_file"] = f"""SELECT doc_id, CASE WHEN coalesce(o, '') <> '' AND contains(coalesce(f, ''), o) THEN {_SPL('f', 'o', "('NEW $& ' || doc_id)")} WHEN coalesce(f, '') <> '' THEN f || chr(10) || chr(10) || 'NEW $& ' || doc_id ELSE 'NEW $& ' || doc_id END AS content
  FROM (SELECT doc_id, {_FILE} AS f, {_OLD} AS o FROM documents)"""

# ── usage and logs ──────────────────────────────────────────────────────

QUERIES["o1_daily_usage"] = lambda spark, sf: O.daily_usage(spark_table(spark, sf, "usage_events")).withColumn("day", F.col("day").cast("string"))
USED = f"(SELECT ip_hash, CAST(ts AS DATE) AS day, CAST(list_reduce(list_concat([0], list(delta ORDER BY ts, event_id)), lambda a, x: greatest(0, a + x)) AS BIGINT) AS used FROM {USE} GROUP BY ip_hash, CAST(ts AS DATE))"
ORACLE["o1_daily_usage"] = f"SELECT ip_hash, CAST(day AS VARCHAR) AS day, used FROM {USED}"
QUERIES["o1_daily_usage_net"] = lambda spark, sf: O.daily_usage_net(spark_table(spark, sf, "usage_events")).withColumn("day", F.col("day").cast("string"))
ORACLE["o1_daily_usage_net"] = f"SELECT ip_hash, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(greatest(0, sum(delta)) AS BIGINT) AS used FROM {USE} GROUP BY ip_hash, CAST(ts AS DATE)"
QUERIES["o2_rate_decision"] = lambda spark, sf: O.rate_decision(O.daily_usage(spark_table(spark, sf, "usage_events")), spark_table(spark, sf, "signups")).withColumn("day", F.col("day").cast("string"))
ORACLE["o2_rate_decision"] = f"""SELECT ip_hash, CAST(day AS VARCHAR) AS day, used, CAST(l AS BIGINT) AS daily_limit, l = 10 AS waitlisted, used < l AS allowed, CAST(greatest(0, l - used) AS BIGINT) AS remaining
  FROM (SELECT *, CASE WHEN ip_hash IN (SELECT ip_hash FROM {SIGN}) THEN 10 ELSE 3 END AS l FROM {USED})"""
QUERIES["o3_allowed_events"] = lambda spark, sf: O.allowed_events(spark_table(spark, sf, "usage_events").filter("delta = 1"), spark_table(spark, sf, "signups")).withColumn("day", F.col("day").cast("string"))
ORACLE["o3_allowed_events"] = f"""SELECT event_id, ip_hash, CAST(day AS VARCHAR) AS day, nth FROM (SELECT event_id, ip_hash, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY ip_hash, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM {USE} WHERE delta = 1)
  WHERE nth <= CASE WHEN ip_hash IN (SELECT ip_hash FROM {SIGN}) THEN 10 ELSE 3 END"""
QUERIES["o4_login_sessions"] = lambda spark, sf: O.login_sessions(spark_table(spark, sf, "access_events")).withColumn("login_ts", F.col("login_ts").cast("string")).withColumn("verified_at", F.col("verified_at").cast("string"))
ORACLE["o4_login_sessions"] = f"""SELECT lower({D.trim('email')}) AS email, CAST(login_ts AS VARCHAR) AS login_ts, arg_max(coalesce(user_agent, 'unknown'), event_id) FILTER (action = 'attempt') AS user_agent,
  CASE WHEN bool_or(action <> 'attempt') THEN 'verified' ELSE 'attempted' END AS status, CAST(max(ts) FILTER (action <> 'attempt') AS VARCHAR) AS verified_at FROM {ACC} GROUP BY lower({D.trim('email')}), login_ts"""
QUERIES["o5_waitlist_first"] = lambda spark, sf: O.waitlist_first(spark_table(spark, sf, "signups"))
ORACLE["o5_waitlist_first"] = f"SELECT ip_hash, event_id, email FROM (SELECT *, row_number() OVER (PARTITION BY ip_hash ORDER BY ts, event_id) AS n FROM {SIGN}) WHERE n = 1"

_MSG = "CASE doc_id % 4 WHEN 0 THEN concat(chr(10), '  ', text, '  ') WHEN 1 THEN concat(' ', chr(9)) ELSE text END"


def _o6(spark, sf):
    d = spark_table(spark, sf, "documents")
    return O.clean_feedback(d.select(F.col("doc_id").alias("feedback_id"), F.expr(_MSG).alias("message"), F.concat(F.lit(" "), "lang", F.lit("@x ")).alias("email"), F.substring("text", 1, 700).alias("audit_url"), F.lit(None).cast("string").alias("page_url")))


QUERIES["o6_clean_feedback"] = _o6
ORACLE["o6_clean_feedback"] = f"""SELECT doc_id AS feedback_id, left({D.trim('m')}, 2000) AS message, lang || '@x' AS email, left(text, 500) AS audit_url, CAST(NULL AS VARCHAR) AS page_url FROM (SELECT *, {_MSG} AS m FROM documents) WHERE {D.trim('m')} <> ''"""


def _o7(spark, sf):
    r = O.audit_rollup(spark_table(spark, sf, "audit_log"))
    return r.withColumns({"day": F.col("day").cast("string"), "mean_score": F.round("mean_score", 6), "mean_ms": F.round("mean_ms", 6)})


QUERIES["o7_audit_rollup"] = _o7
ORACLE["o7_audit_rollup"] = f"""SELECT CAST(CAST(submitted_at AS DATE) AS VARCHAR) AS day, status, coalesce(reason, '') AS reason, count(*) AS audits, round(avg(overall_score), 6) AS mean_score, min(overall_score) AS min_score, max(overall_score) AS max_score,
  round(avg(analysis_ms), 6) AS mean_ms, max(analysis_ms) AS max_ms FROM {AUD} GROUP BY CAST(submitted_at AS DATE), status, coalesce(reason, '')"""
QUERIES["o8_latest_category_result"] = lambda spark, sf: O.latest_category_result(spark_table(spark, sf, "progress_events"))
ORACLE["o8_latest_category_result"] = f"SELECT session_id, category, message, data FROM (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY ts DESC, event_id DESC) AS n FROM {PRO} WHERE type = 'category-result') WHERE n = 1"


def _o9(spark, sf):
    d = spark_table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.repeat("text", 1 + (F.col("doc_id") % 12).cast("int")).alias("data"))
    return O.cap_payload(d).select("event_id", "truncated", F.length("data").cast("long").alias("chars"))


QUERIES["o9_cap_payload"] = _o9
# JSON adds one backslash for each quote, backslash and control character of these texts
_JB = """strlen('{"event_id":' || doc_id || ',"data":"' || replace(replace(replace(replace(replace(d, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"}')"""
ORACLE["o9_cap_payload"] = f"""SELECT doc_id AS event_id, {_JB} > {K.MAX_PAYLOAD_BYTES} AS truncated, CAST(CASE WHEN {_JB} > {K.MAX_PAYLOAD_BYTES} THEN length('{{"_truncated":true,"message":"{O.TRUNCATION_NOTE}"}}') ELSE length(d) END AS BIGINT) AS chars
  FROM (SELECT doc_id, repeat(text, 1 + doc_id % 12) AS d FROM documents)"""
QUERIES["o10_phase_durations"] = lambda spark, sf: O.phase_durations(spark_table(spark, sf, "progress_events"))
ORACLE["o10_phase_durations"] = f"""SELECT event_id, session_id, phase, CAST(floor((epoch_us(nxt) - epoch_us(ts)) / 1000) AS BIGINT) AS duration_ms FROM (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS nxt FROM {PRO})"""
QUERIES["o11_expire"] = lambda spark, sf: O.expire(spark_table(spark, sf, "events"), "ts", F.expr(NOW)).select("event_id")
ORACLE["o11_expire"] = f"SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY >= {NOW}"
