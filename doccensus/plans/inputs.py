"""Inputs the registered queries derive from the given tables.

Every derivation is plain SQL that both Spark and the checking engine run
unchanged, so an operator and its check start from the same rows. ``{name}``
is a given table or another derivation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from doccensus.functions.common import by_shuffle

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_CUT = "instr(substring(url, 9), '/')"

DERIVED: dict[str, str] = {}

# pages with varied paths and the markup the raw corpus lacks
DERIVED["audit_pages"] = f"""
SELECT page_id,
  concat(substring(url, 1, {_CUT} + 7),
    CASE page_id % 8 WHEN 0 THEN '/docs/guides/api' WHEN 1 THEN '/docs' WHEN 2 THEN '/reference/functions'
      WHEN 3 THEN '' WHEN 4 THEN '/blog' WHEN 5 THEN '/tutorials/getting-started'
      WHEN 6 THEN '/API/v1-refrence_guide' ELSE '/how-to/Configration' END,
    substring(url, {_CUT} + 8)) AS url,
  replace(replace(html, '</head>', concat(
    CASE page_id % 3 WHEN 0 THEN concat('<link rel="canonical" href="', url, '">')
      WHEN 1 THEN concat('<link href="', url, '" rel="canonical">') ELSE '' END,
    CASE page_id % 4
      WHEN 0 THEN '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="I"><meta property="og:type" content="article">'
      WHEN 1 THEN '<meta content="Only title" property="og:title"><meta property="og:title" content="First">' ELSE '' END,
    CASE page_id % 6
      WHEN 0 THEN '<script type="application/ld+json">{{"@context": "https://schema.org", "@type": "TechArticle", "headline": "H", "author": "A", "datePublished": "2024-01-01"}}</script>'
      WHEN 1 THEN '<script type="application/ld+json">{{"@type": "TechArticle", "headline": "H", "datePublished": "2024-01-01"}}</script>'
      WHEN 2 THEN '<script type="application/ld+json">{{"@type": ["Course", "Thing"], "name": "N"}}</script>'
      WHEN 3 THEN '<script type="application/ld+json">{{"@type": "HowTo", broken</script>'
      WHEN 4 THEN '<script type="application/ld+json">{{"@type": "BreadcrumbList", "itemListElement": []}}</script><script type="application/ld+json">{{"@type": "WebSite", "name": "S"}}</script>'
      ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<meta name="robots" content="NOINDEX, follow">'
         WHEN page_id % 7 = 1 THEN '<meta content="index" name="robots">' ELSE '' END,
    CASE WHEN page_id % 7 < 3 THEN concat('<meta name="description" content="Learn about widget number ', CAST(page_id AS STRING), ', quickly and easily.">') ELSE '' END,
    CASE page_id % 5
      WHEN 0 THEN '<link rel="alternate" type="text/markdown" href="/md/page.md">'
      WHEN 1 THEN '<link type="text/markdown" rel="alternate" href="https://md.example.com/p.md">'
      WHEN 2 THEN '<link href="raw.md" rel="alternate" type="text/markdown">' ELSE '' END,
    '</head>')),
  '</article>', concat(
    CASE page_id % 5
      WHEN 0 THEN '<h2>Getting <em>started</em></h2><h2>Usage</h2><h2>Limits</h2>'
      WHEN 1 THEN '<h3>Deep first</h3>' WHEN 2 THEN '<h1>Second title</h1><h2>Part</h2>'
      WHEN 3 THEN '<h2> </h2><h2 class="x">Kept</h2><h4>Skip</h4>' ELSE '' END,
    CASE page_id % 4
      WHEN 0 THEN '<pre><code class="language-python">print(1 + 2) # since version 2.1</code></pre>'
      WHEN 1 THEN '<pre>plain block of text</pre>'
      WHEN 2 THEN 'Use <code>alpha</code>, <code>const beta = 1</code> and <code class="lang-js x">gamma =&gt; delta</code>. Run npm install now.' ELSE '' END,
    CASE page_id % 8
      WHEN 0 THEN '<img src="/a.png" alt="A picture" title="Cap">' WHEN 1 THEN '<img src="/b.png">'
      WHEN 2 THEN '<iframe src="https://www.youtube.com/embed/1"></iframe>' WHEN 3 THEN '<form action="/go"><input name="q"></form>'
      WHEN 4 THEN '<video src="/v.mp4"></video><iframe src="https://player.vimeo.com/2"></iframe>' ELSE '' END,
    CASE WHEN page_id % 9 = 0 THEN '<table><tr><th>Parameter</th><th>Type</th></tr><tr><td><code>a</code></td><td>Field</td><td>required</td></tr></table> GET /x and POST /y' ELSE '' END,
    CASE WHEN page_id % 11 = 0 THEN '<div id="root"> </div>' ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN '<a href="https://other.example.com/docs/x?y=1">Other <b>site</b></a><a href="mailto:a@b.c">Mail</a><a href="#top">Top</a><a href="https://github.io/z">Zed</a><a href="/guide.md">Guide md</a>'
         WHEN page_id % 3 = 1 THEN concat('<a href="sub/child">Child</a><a href="../up/./one">Up</a><a href="', url, '">Self</a><a href="https://twitter.com/q"></a><a href="/the?x=1#f">the again</a>')
         ELSE '<a href="javascript:void(0)">Js</a><a href="?page=3">Next</a><a href="//cdn.example.com/lib">Cdn</a><a href="/docs/guides/">Guides</a><a href="/and">And twice</a>' END,
    '</article>')) AS html
FROM {{pages}}
"""

# documents as markdown with headings, lists, tables, fences and links
DERIVED["markdown_docs"] = """
SELECT doc_id, source, concat('Notes on ', substring(replace(text, chr(10), ' '), 1, 24)) AS title,
  concat('https://docs.example.com/en/', CAST(doc_id AS STRING)) AS url,
  concat(
    CASE doc_id % 4 WHEN 0 THEN concat('# Overview of parts', chr(10), chr(10))
      WHEN 1 THEN concat('# Setup', chr(10), '### Deep', chr(10)) WHEN 2 THEN concat('## Quick start', chr(10)) ELSE '' END,
    text,
    CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), chr(10), '- one', chr(10), '* two', chr(10), '3. three', chr(10)) ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), '| 3 | 4 |', chr(10)) ELSE '' END,
    CASE doc_id % 6 WHEN 0 THEN concat(chr(10), '```python', chr(10), 'x = 1', chr(10), '```', chr(10))
      WHEN 1 THEN concat(chr(10), '```', chr(10), repeat('long code ', 30), chr(10), '```', chr(10), chr(10), chr(10), chr(10)) ELSE '' END,
    CASE doc_id % 4 WHEN 0 THEN ' [int](/docs/a) [ext](https://x.org/p) [same](https://docs.example.com/q) ![img](/i.png)'
      WHEN 1 THEN concat(chr(10), '## Terms', chr(10), '**Term**: meaning <b>x</b>', chr(10), chr(10), chr(10), chr(10), 'end') ELSE '' END) AS md
FROM {documents}
"""

# documents as discussion pages with code, errors, tags and stack frames
DERIVED["posts"] = """
SELECT doc_id, concat(
  '<div class="s-prose js-post-body" itemprop="text"><p>', text, '</p>',
  CASE doc_id % 4 WHEN 0 THEN '<pre><code class="language-js">const a = await fetch(&quot;/x&quot;); // &lt;tag&gt;</code></pre>'
    WHEN 1 THEN '<pre><code>short</code></pre><code>let y =&gt; 2</code>' WHEN 2 THEN '<code>plain word</code>' ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN concat('TypeError: cannot read value of widget ', CAST(doc_id % 10 AS STRING), chr(10))
    WHEN 1 THEN concat('Request Failed: upstream closed the socket', chr(10), '500 error: internal failure happened', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN 'at app.run (main.js:1) at app.boot (main.js:2) at Object.go (lib.js:3)' ELSE ' at one.two (x.js:9)' END,
  ' see /docs/setup and /docs/api/keys) or /docs/a /docs/b</div></div>',
  CASE WHEN doc_id % 2 = 0 THEN '<div class="s-prose js-post-body" data-x itemprop="text">Second answer</div> </div>' ELSE '' END,
  '<a href="/t/1" class="post-tag t1" rel="tag">python</a><a class="post-tag">api-keys </a>') AS html
FROM {documents}
"""

# one crawl target per audited page: site base URL and host
DERIVED["sites"] = f"""
SELECT DISTINCT substring(url, 1, {_CUT} + 7) AS base_url FROM {{pages}}
"""


DERIVED["robots_files"] = """
SELECT concat('site', CAST(c_custkey AS STRING), '.example.com') AS domain,
  CASE c_custkey % 12
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('User-agent: GPTBot', chr(10), 'User-agent: ClaudeBot', chr(10), 'Disallow: /', chr(10))
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /')
    WHEN 3 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'Allow: /docs', chr(10))
    WHEN 4 THEN concat('User-agent: GPTBot', chr(10), chr(10), 'User-agent: CCBot', chr(10), 'Disallow: /')
    WHEN 5 THEN concat('# rules', chr(10), 'USER-AGENT: GPTBot ', chr(10), 'Disallow: /private', chr(10), 'sitemap: https://', c_mktsegment, '.example.com/map.xml ', chr(10))
    WHEN 6 THEN concat('User-agent: gptbot', chr(10), 'Disallow: /')
    WHEN 7 THEN concat('User-agent: GPTBot', chr(10), 'Disallow:', chr(10), '# Bingbot is fine', chr(10), 'User-agent: *', chr(10), 'Disallow: /', chr(10))
    WHEN 8 THEN concat('Sitemap: /relative.xml', chr(10), 'User-agent: *', chr(10), 'Crawl-delay: 2', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /', chr(10))
    WHEN 9 THEN concat('Disallow: /', chr(10), 'User-agent: Amazonbot', chr(10), '# note', chr(10), 'User-agent: CCBot', chr(10), 'Allow: /', chr(10), 'User-agent: Bytespider', chr(10), 'User-agent: *', chr(10), 'Disallow: /', chr(10), 'Sitemap: https://cdn.example.com/s.xml.gz')
    WHEN 10 THEN concat('User-agent: *', chr(10), 'Allow: /', chr(10), chr(10), 'User-agent: GPTBot', chr(10), 'Disallow: /x', chr(10), 'Disallow: /y', chr(10), 'Allow: /z', chr(10), 'User-agent: Claude-Web', chr(10), 'Disallow: /tmp')
    ELSE '' END AS body
FROM {customer}
"""

# llms.txt of every site, at most 100 pages per file
DERIVED["llms_files"] = f"""
SELECT base_url, bucket, concat('# ', base_url, chr(10), '> Docs of the site', chr(10), '- Basics', chr(10), chr(10), AGGLINES(line, page_id), chr(10),
  '## OpenAPI Specs', chr(10), '- [spec](https://api.example.com/', CAST(bucket AS STRING), '/openapi.json)', chr(10), 'see https://api.example.com/v2.yaml now', chr(10),
  '## Optional', chr(10), '- [Extra](', base_url, '/extra): llms-full.txt') AS body
FROM (SELECT page_id, CAST(floor(page_id / 100) AS BIGINT) AS bucket, substring(url, 1, {_CUT} + 7) AS base_url,
  CASE page_id % 7
    WHEN 0 THEN concat('- [Page ', CAST(page_id AS STRING), '](', url, '): About number ', CAST(page_id AS STRING), ' ')
    WHEN 1 THEN concat('[Rel ', CAST(page_id AS STRING), '](', substring(url, {_CUT} + 8), ')')
    WHEN 2 THEN url
    WHEN 3 THEN concat('- [Md](', url, '.md) trailing')
    WHEN 4 THEN concat('# Section ', CAST(page_id AS STRING))
    WHEN 5 THEN concat('- [Bare](guide/', CAST(page_id AS STRING), '.html) : Described')
    ELSE concat('  - [Up](', base_url_of, '/docs/) text ', url) END AS line
  FROM (SELECT page_id, url, substring(url, 1, {_CUT} + 7) AS base_url_of FROM {{audit_pages}})) GROUP BY base_url, bucket
"""

# sitemap files: root index, middle index, leaves of at most 100 pages
DERIVED["sitemap_files"] = f"""
SELECT concat(base_url, '/sitemap.xml') AS url, base_url, concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', AGGLINES(line, top), '</sitemapindex>') AS body
FROM (SELECT DISTINCT base_url, top, concat('<sitemap><loc>', base_url, '/sitemap-m', CAST(top AS STRING), '.xml</loc></sitemap>') AS line FROM (
  SELECT substring(url, 1, {_CUT} + 7) AS base_url, CAST(floor(page_id / 100000) AS BIGINT) AS top FROM {{audit_pages}})) GROUP BY base_url
UNION ALL
SELECT concat(base_url, '/sitemap-m', CAST(top AS STRING), '.xml') AS url, base_url, concat('<sitemapindex>', AGGLINES(line, bucket), '<sitemap><loc> ', base_url, '/sitemap-m', CAST(top AS STRING), '.xml </loc></sitemap></sitemapindex>') AS body
FROM (SELECT DISTINCT base_url, top, bucket, concat('<sitemap><loc>', base_url, '/sitemap-', CAST(bucket AS STRING), '.xml</loc></sitemap>') AS line FROM (
  SELECT substring(url, 1, {_CUT} + 7) AS base_url, CAST(floor(page_id / 100000) AS BIGINT) AS top, CAST(floor(page_id / 100) AS BIGINT) AS bucket FROM {{audit_pages}})) GROUP BY base_url, top
UNION ALL
SELECT concat(base_url, '/sitemap-', CAST(bucket AS STRING), '.xml') AS url, base_url, concat('<urlset>', AGGLINES(line, page_id), '</urlset>') AS body
FROM (SELECT page_id, CAST(floor(page_id / 100) AS BIGINT) AS bucket, substring(url, 1, {_CUT} + 7) AS base_url,
  concat('<url><loc>', CASE page_id % 6 WHEN 5 THEN 'ftp://x.example.com/f' WHEN 4 THEN 'https://shared.example.com/s' ELSE url END, '</loc></url>') AS line FROM {{audit_pages}}) GROUP BY base_url, bucket
"""

# robots.txt of every crawled site
DERIVED["site_robots"] = """
SELECT base_url, CASE length(base_url) % 5
    WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'Sitemap: ', base_url, '/sitemap.xml')
    WHEN 1 THEN concat('User-agent: GPTBot', chr(10), 'Disallow: /', chr(10), 'Sitemap: ', base_url, '/maps/all.xml.gz')
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /')
    WHEN 3 THEN concat('User-agent: CCBot', chr(10), 'Disallow: /', chr(10)) ELSE NULL END AS body
FROM {sites}
"""

_PROBES = [
    ("/llms.txt", "llms.txt", 3), ("/docs/llms.txt", "llms.txt", 5), ("/docs/guides/llms.txt", "llms.txt", 7),
    ("/hinted/llms.txt", "llms.txt", 4), ("/.well-known/llms.txt", "llms.txt", 2), ("/llms-full.txt", "llms-full.txt", 4),
    ("/docs/llms-full.txt", "llms-full.txt", 3), ("/AGENTS.md", "AGENTS.md", 3), ("/.well-known/mcp.json", "mcp.json", 4),
    ("/sitemap.xml", "sitemap.xml", 3), ("/sitemap_index.xml", "sitemap.xml", 4), ("/sitemap/sitemap.xml", "sitemap.xml", 5),
    ("/maps/all.xml.gz", "sitemap.xml", 2), ("/md/page.md", "markdown-alternate", 3), ("/raw.md", "markdown-alternate", 4),
]
_TYPE_OF = {"mcp.json": "application/json", "sitemap.xml": "application/xml"}
_PROBE_ROWS = ", ".join(
    f"({i}, {k + 2}, '{p}', '{purpose}', '{_TYPE_OF.get(purpose, 'text/plain')}')" for i, (p, purpose, k) in enumerate(_PROBES)
)
# every site meets the fifteen fixed probe kinds
DERIVED["fetch_log"] = f"""SELECT concat(base_url, path) AS url, purpose, CASE (length(base_url) * 7 + i) % m
  WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 403 WHEN 4 THEN 0 ELSE 500 END AS status_code,
  CASE (length(base_url) * 7 + i) % m WHEN 1 THEN 'text/html; charset=utf-8' ELSE ctype END AS content_type,
  CAST(length(base_url) * (i + 3) AS BIGINT) AS duration_ms FROM {{sites}} FANOUT[kinds; i, m, path, purpose, ctype; {_PROBE_ROWS}]
UNION ALL SELECT concat(regexp_replace(url, '/$', ''), '.md') AS url, 'direct-md' AS purpose,
  CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 ELSE 0 END AS status_code,
  CASE page_id % 4 WHEN 1 THEN 'text/html' ELSE 'text/markdown' END AS content_type, CAST(page_id % 300 AS BIGINT) AS duration_ms FROM {{audit_pages}}
UNION ALL SELECT url, 'content-negotiation' AS purpose, CASE page_id % 6 WHEN 5 THEN 404 ELSE 200 END AS status_code,
  CASE page_id % 6 WHEN 0 THEN 'text/markdown; charset=utf-8' ELSE 'text/html' END AS content_type, CAST(page_id % 200 AS BIGINT) AS duration_ms FROM {{audit_pages}}"""

# response headers of every page as plain columns
DERIVED["page_headers"] = f"""
SELECT page_id, url, html, CASE page_id % 6
    WHEN 0 THEN '</hinted/llms.txt>; rel="llms-txt", </hinted/llms-full.txt>; rel="llms-full-txt"'
    WHEN 1 THEN '<https://md.example.com/h.md>; rel="alternate"; type="text/markdown"'
    WHEN 2 THEN '</x.md>; type="text/markdown"; rel="alternate"' ELSE '' END AS link,
  CASE WHEN page_id % 10 = 0 THEN '/docs/llms.txt' ELSE '' END AS x_llms_txt,
  CASE page_id % 3 WHEN 0 THEN 'Accept, Cookie' ELSE 'Origin' END AS vary,
  CASE WHEN page_id % 12 = 0 THEN 'noindex' ELSE '' END AS x_robots_tag
FROM {{audit_pages}}
"""

# HEAD and GET results of links, several per URL over time
DERIVED["link_log"] = """
SELECT event_id, ts, concat('https://site', CAST(user_id % 9 AS STRING), '.example.com/p/', CAST((event_id * 7) % 1500 AS STRING)) AS url,
  concat('site', CAST(user_id % 9 AS STRING), '.example.com') AS domain,
  CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'HEAD' END AS method,
  CASE event_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 401 WHEN 3 THEN 500 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 301 WHEN 7 THEN 405 ELSE 200 END AS status_code,
  CASE event_id % 11 WHEN 4 THEN 'timeout' WHEN 5 THEN 'error' ELSE NULL END AS failure,
  CAST(floor(value) AS BIGINT) AS duration_ms FROM {events}
"""

# scores of five dimensions per document
_DIMS = ["relevance", "freshness", "clarity", "accuracy", "completeness"]
DERIVED["dimension_results"] = " UNION ALL ".join(
    f"""SELECT doc_id AS page, '{d}' AS dimension, CASE doc_id % 11 WHEN 0 THEN 'api-reference' WHEN 1 THEN 'tutorial' WHEN 2 THEN 'conceptual' WHEN 3 THEN 'how-to'
    WHEN 4 THEN 'overview' WHEN 5 THEN 'reference' WHEN 6 THEN 'troubleshooting' WHEN 7 THEN 'changelog' WHEN 8 THEN 'product-guide' WHEN 9 THEN 'mixed' ELSE 'blog-post' END AS content_type,
    CASE WHEN (doc_id + {k}) % 7 = 0 OR doc_id % 50 = 49 THEN NULL ELSE CAST((doc_id * 13 + {k} * 29 + n_chars) % 101 AS DOUBLE) END AS score,
    CASE WHEN (doc_id + {k}) % 7 = 0 OR doc_id % 50 = 49 THEN 'failed' WHEN (doc_id + {k}) % 9 = 0 THEN 'retry' ELSE 'complete' END AS status FROM {{documents}}"""
    for k, d in enumerate(_DIMS)
)
DERIVED["findings"] = " UNION ALL ".join(
    f"""SELECT doc_id AS page, '{d}' AS dimension, {p} AS pos, {t} AS finding FROM {{documents}} WHERE doc_id % {m} <> 1"""
    for k, d in enumerate(_DIMS)
    for p, m, t in [(0, 2, "'Content type: mixed (weight: 20%)'"), (1, 3, f"concat('Uses {d} of ', substring(text, 1, 15))"), (2, 5, "concat('Length ', CAST(n_chars AS STRING))"), (3, 4, "'Third'")]
)

# what each session has written
DERIVED["artifacts"] = """
SELECT concat('s', CAST(event_id % 1200 AS STRING)) AS session_id, ts,
  CASE (event_id * 31 + user_id) % 9 WHEN 0 THEN 'sitemap-health' WHEN 1 THEN 'report' WHEN 2 THEN 'dimensions' WHEN 3 THEN 'content' WHEN 4 THEN 'status' ELSE 'metadata' END AS artifact,
  CASE user_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' ELSE 'running' END AS state
FROM {events}
"""

# knowledge store: one row per audited page, some urls twice
DERIVED["kb_rows"] = f"""
SELECT page_id, url, concat('Title ', CAST(page_id AS STRING)) AS title, CASE page_id % 4 WHEN 0 THEN 'tutorial' WHEN 1 THEN 'reference' ELSE 'mixed' END AS documentation_type,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat('Topic ', CAST(page_id % 17 AS STRING)) END AS topic, 'a;b' AS covers, 'k1;k2' AS key_terms
FROM {{audit_pages}}
"""

# repository issues from documents; the time comes from the event of the same number
DERIVED["issues"] = """
SELECT d.doc_id AS number, concat('repo', CAST(d.doc_id % 7 AS STRING)) AS repo,
  CASE d.doc_id % 3 WHEN 0 THEN 'example-com' WHEN 1 THEN 'example-net' ELSE 'example-org' END AS site,
  concat(CASE d.doc_id % 8 WHEN 0 THEN 'Unclear documentation for reference functions ' WHEN 1 THEN 'How to deploy guides with vercel docs api ' WHEN 2 THEN 'API key token rejected in getting started '
    WHEN 3 THEN 'Email marked as spam by blog ' WHEN 4 THEN 'Webhook event never arrives ' WHEN 5 THEN '429 error: too many requests ' ELSE '' END, replace(substring(d.text, 1, 60), chr(10), ' ')) AS title,
  CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE substring(d.text, 61) END AS body,
  CASE d.doc_id % 9 WHEN 0 THEN 'Documentation;p1' WHEN 1 THEN 'bug' WHEN 2 THEN 'good first issue;area: docs' ELSE 'p2' END AS label_text,
  CASE d.doc_id % 6 WHEN 0 THEN 'deployment' WHEN 1 THEN 'email-delivery' WHEN 2 THEN 'api-usage' WHEN 3 THEN 'authentication' WHEN 4 THEN 'documentation' ELSE 'other' END AS category,
  coalesce(e.ts, TIMESTAMP '2024-01-20 00:00:00') AS created_at, CASE WHEN d.doc_id % 6 = 5 THEN 'closed' ELSE 'open' END AS state, CAST(d.doc_id % 13 AS BIGINT) AS reactions, d.doc_id % 20 AS comments
FROM {documents} d LEFT JOIN {events} e ON e.event_id = d.doc_id * 10
"""

# question statistics and ranked issues from events
DERIVED["questions"] = """
SELECT CAST(event_id AS STRING) AS question_id, concat(event_type, ' ', CASE event_id % 5 WHEN 0 THEN 'How to configure the token for every production environment we run today'
    WHEN 1 THEN 'Webhook callback' WHEN 2 THEN 'Plain question about a thing that is long enough to be cut at eighty characters, or even at one hundred and twenty'
    WHEN 3 THEN 'Outdated docs' ELSE 'Quota exceeded' END, ' ', CAST(event_id AS STRING)) AS title,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS view_count, CAST(event_id % 9 AS BIGINT) AS score,
  concat('company', CAST(user_id % 40 AS STRING)) AS company, CAST(ts AS DATE) AS last_seen
FROM {events}
"""

# owners with repositories and file listings
DERIVED["repos"] = """
SELECT concat('org', CAST(c_nationkey AS STRING)) AS owner, concat(CASE c_custkey % 9 WHEN 0 THEN 'docs-' WHEN 1 THEN 'docker-' WHEN 2 THEN 'dev_portal-' WHEN 3 THEN 'Wiki-' ELSE 'app-' END, CAST(c_custkey AS STRING)) AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'The API reference for all' WHEN 1 THEN NULL WHEN 2 THEN 'A tool' ELSE 'Docs portal thing' END AS description,
  CASE WHEN c_custkey % 11 = 0 THEN 'python;my docs' ELSE 'go' END AS topic_text, c_custkey % 13 = 0 AS is_current, c_custkey AS updated_at
FROM {customer}
"""
DERIVED["repo_files"] = """
SELECT r.owner, r.name AS repo, CASE o_orderkey % 12 WHEN 0 THEN concat('docs/p', CAST(o_orderkey AS STRING), '.md') WHEN 1 THEN 'README.md' WHEN 2 THEN concat('guide', CAST(o_orderkey AS STRING), '.MDX')
    WHEN 3 THEN concat('src/a', CAST(o_orderkey AS STRING), '.ts') WHEN 4 THEN 'index.tsx' WHEN 5 THEN 'docs' WHEN 6 THEN concat('wiki/', CAST(o_orderkey AS STRING), '.mdx')
    WHEN 7 THEN concat('deep/docs/', CAST(o_orderkey AS STRING), '.md') WHEN 8 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'LLMS.txt' ELSE 'main.js' END ELSE concat('notes', CAST(o_orderkey AS STRING), '.md') END AS path,
  CASE WHEN o_orderkey % 12 = 5 THEN 'dir' ELSE 'file' END AS type
FROM {orders} JOIN {repos} r ON r.updated_at = o_custkey
"""

# citations returned for the first three queries of every page
DERIVED["citations"] = f"""
SELECT page_id, url AS target_url, qp AS query_pos, CASE qp WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS tier, cp AS pos,
  CASE WHEN (page_id + qp) % 5 = 4 THEN NULL WHEN (page_id + qp) % 5 = 3 THEN CASE cp WHEN 0 THEN 'https://www.google.com/x' WHEN 1 THEN concat('https://www.rival', CAST(page_id % 3 AS STRING), '.org/a') WHEN 2 THEN 'https://rival1.org/b' ELSE concat('https://third', CAST(cp AS STRING), '.dev') END
    WHEN (page_id + qp) % 5 = 2 THEN CASE cp WHEN 1 THEN concat('https://mirror.org/?u=', url) ELSE 'https://youtube.com/v' END
    WHEN (page_id + qp) % 5 = 1 THEN CASE cp WHEN 2 THEN replace(url, 'https://', 'http://www.') WHEN 0 THEN 'not-a-url' ELSE 'https://fourth.io/q' END
    ELSE concat('https://fifth', CAST((page_id + cp) % 4 AS STRING), '.example.com/z') END AS cited_url
FROM {{audit_pages}} FANOUT[slots; qp, cp; (0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]
"""

# analysis starts and refunds per client
DERIVED["usage_events"] = """
SELECT event_id, concat('ip', CAST(user_id AS STRING)) AS ip_hash, ts, CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END AS delta FROM {events}
"""
DERIVED["signups"] = """
SELECT event_id, concat('ip', CAST(user_id AS STRING)) AS ip_hash, ts, concat('u', CAST(event_id AS STRING), '@example.com') AS email FROM {events} WHERE event_type = 'signup' AND user_id % 3 = 0
"""

# sign-in attempts and their confirmations
DERIVED["access_events"] = """
SELECT concat(CASE event_id % 3 WHEN 0 THEN ' User' ELSE 'user' END, CAST(user_id AS STRING), '@Example.com ') AS email, ts AS login_ts, 'attempt' AS action, ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'agent' END AS user_agent, event_id FROM {events} WHERE event_type IN ('click', 'view')
UNION ALL
SELECT concat('user', CAST(user_id AS STRING), '@example.com') AS email, ts AS login_ts, 'verified' AS action, ts + INTERVAL '1' MINUTE AS ts, NULL AS user_agent, event_id FROM {events} WHERE event_type IN ('click', 'view') AND event_id % 2 = 0
UNION ALL
SELECT concat('ghost', CAST(user_id AS STRING), '@example.com') AS email, ts AS login_ts, 'verified' AS action, ts, NULL AS user_agent, event_id FROM {events} WHERE event_type = 'error' AND event_id % 50 = 0
"""

DERIVED["audit_log"] = """
SELECT event_id, concat('s', CAST(event_id AS STRING)) AS session_id, ts AS submitted_at, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN CASE user_id % 3 WHEN 0 THEN 'not-documentation' ELSE 'rate-limit' END ELSE NULL END AS reason,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CAST(event_id % 101 AS BIGINT) ELSE NULL END AS overall_score, CAST(floor(value * 100) AS BIGINT) AS analysis_ms FROM {events}
"""

DERIVED["progress_events"] = """
SELECT event_id, concat('s', CAST(user_id AS STRING)) AS session_id, ts, CASE WHEN event_id % 4 = 0 THEN 'category-result' ELSE 'progress' END AS type, event_type AS phase,
  CASE event_id % 5 WHEN 0 THEN 'botAccess' WHEN 1 THEN 'discoverability' WHEN 2 THEN 'consumability' ELSE 'structuredData' END AS category,
  concat('m', CAST(event_id AS STRING)) AS message, concat('d', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS data FROM {events}
"""

# store rows: old and new versions of page entries
DERIVED["kb_versions"] = """
SELECT p.page_id, p.url, concat('v', CAST(k.v AS STRING), ' ', CAST(p.page_id AS STRING)) AS title, CASE WHEN k.v = 1 THEN 'doc-audit' ELSE 'github-issues' END AS source,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * CAST((p.page_id * (k.v + 2)) % 20 AS INT) AS crawled_at, k.v AS version
FROM {audit_pages} p FANOUT[k; v; (0), (1)] WHERE p.page_id % 3 >= k.v
"""

# requests against processed pages with a cached copy for some
DERIVED["cache_requests"] = """
SELECT x.event_id, CASE x.user_id % 2 WHEN 0 THEN 'with-context' ELSE 'without-context' END AS contextual_setting, p.url
FROM (SELECT e.event_id, e.user_id, e.event_id % c.n AS page FROM {events} e CROSS JOIN (SELECT count(*) AS n FROM {pages}) c) x JOIN {audit_pages} p ON p.page_id = x.page
"""

DERIVED["timed_requests"] = """
SELECT r.event_id, r.contextual_setting, r.url, e.ts FROM {cache_requests} r JOIN {events} e ON e.event_id = r.event_id
"""

# four versions of every page's entry, eight days apart, that last one, three, five or seven days
DERIVED["cache_versions"] = """
SELECT page_id, url, k AS version, CASE (page_id + k) % 3 WHEN 0 THEN 'without-context' ELSE 'with-context' END AS contextual_setting,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((page_id * 7) % 60 + k * 192 AS INT) AS processed_at,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((page_id * 7) % 60 + k * 192 + 24 + 48 * (page_id % 4) AS INT) AS ttl
FROM {audit_pages} FANOUT[n; k; (0), (1), (2), (3)]
"""

DERIVED["fixes"] = """
SELECT doc_id, concat('f', CAST(doc_id AS STRING), '-', CAST(k AS STRING)) AS fix_id, concat('sess', CAST(doc_id % 50 AS STRING)) AS session_id, k AS pos,
  CASE (doc_id + k) % 6 WHEN 0 THEN 'CODE_UPDATE' WHEN 1 THEN 'LINK_FIX' WHEN 2 THEN 'CONTENT_ADDITION' WHEN 3 THEN 'VERSION_UPDATE' WHEN 4 THEN 'FORMATTING_FIX' ELSE 'OTHER' END AS category,
  CASE k WHEN 0 THEN substring(text, 5, 30) WHEN 1 THEN concat('NEW', CAST(doc_id AS STRING)) WHEN 2 THEN 'zq zq' ELSE replace(substring(text, 60, 80), ' ', '  ') END AS original,
  CASE k WHEN 0 THEN concat('NEW', CAST(doc_id AS STRING), ' $1 text') WHEN 1 THEN 'SECOND' ELSE concat('R', CAST(k AS STRING)) END AS proposed,
  CAST((doc_id * 7 + k) % 101 AS INT) AS confidence, concat('why ', CAST(k AS STRING)) AS rationale
FROM {documents} FANOUT[n; k; (0), (1), (2), (3)]
"""

# one-file dumps of documents with two top-level sections
DERIVED["llms_full_files"] = """
SELECT doc_id, concat('# Part one', chr(10), substring(text, 1, 450), chr(10), '# ', chr(10), substring(text, 451, 300), chr(10), '## Sub', chr(10), '# Rest', chr(10), substring(text, 751)) AS body FROM {documents}
"""


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


# tables whose rows are expensive to work through, with the column that spreads them
_TEXT_TABLES = {"pages": ("page_id",), "documents": ("doc_id",)}


_LAYOUT: dict = {}


def _layout(spark: SparkSession, path: str) -> tuple:
    """Schema of a table and whether it has fewer pieces than there are cores."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _LAYOUT:
        df = spark.read.parquet(path)
        _LAYOUT[key] = (df.schema, df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism)
    return _LAYOUT[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text tables in very few pieces are spread over all cores;
    a table of many files or row groups, the normal case, is left alone."""
    path = f"{sf_dir}/{name}.parquet"
    schema, few = _layout(spark, path)
    df = spark.read.schema(schema).parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism, *_TEXT_TABLES[name]) if few and name in _TEXT_TABLES else df


#: tables that a derivation joins row by row and that grow with the input, so that they never come to the driver
_BY_SHUFFLE = {"issues": ["events"]}

_FANOUT = re.compile(r"FANOUT\[(\w+); ([^;]+); (.*?)\]", re.S)


def _inline_rows(m: re.Match) -> str:
    """Fixed rows beside every row: generated in place here, a VALUES list elsewhere."""
    rows = re.sub(r"\((?=[^()]*\))", "struct(", m[3])
    return f"LATERAL VIEW inline(array({rows})) {m[1]} AS {m[2]}"


def derived_from(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A derivation over the frames given for its tables."""
    text = _FANOUT.sub(_inline_rows, DERIVED[name])
    text = re.sub(r"AGGLINES\((\w+), (\w+)\)", r"array_join(transform(array_sort(collect_list(struct(\2, \1))), x -> x.\1), chr(10))", text)
    text = text.replace("{", "{{").replace("}", "}}")
    for w in tables:
        text = text.replace("{{" + w + "}}", "{" + w + "}")
    return spark.sql(text, **tables)


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE_TABLES:
        return read_table(spark, sf_dir, name)
    tables = {w: spark_table(spark, sf_dir, w) for w in _names(DERIVED[name])}
    return derived_from(spark, name, **tables | {w: by_shuffle(tables[w]) for w in _BY_SHUFFLE.get(name, ())})


def oracle_table(name: str) -> str:
    """The same derivation as a parenthesised subquery for the checking engine."""
    if name in BASE_TABLES:
        return name
    text = re.sub(r"AGGLINES\((\w+), (\w+)\)", r"string_agg(\1, chr(10) ORDER BY \2, \1)", DERIVED[name])
    text = _FANOUT.sub(r"CROSS JOIN (VALUES \3) AS \1(\2)", text)
    for w in _names(text):
        text = text.replace("{" + w + "}", oracle_table(w))
    return "(" + text.strip() + ")"
