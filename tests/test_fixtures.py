"""Hand-computed rows for every rule branch."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions import html as H
from doccensus.functions import urls as U
from doccensus.functions.common import number_rows, top_k
from doccensus.operators import citations as C
from doccensus.operators import evidence as V
from doccensus.operators import fixes as X
from doccensus.operators import issues as I
from doccensus.operators import pages as PG
from doccensus.operators import probes as P
from doccensus.operators import robots as R
from doccensus.operators import scoring as G
from doccensus.operators import sitefiles as S
from doccensus.operators import usage as O
from doccensus.sources import model_io as M
from doccensus.sources import readers as RD
from doccensus.sources import stores as ST


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or ("",)], schema).select(column).first()[0]


# ── URLs ────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("raw, expected", [
    ("HTTPS://EX.com/a/?b=2&a=1#t", "https://ex.com/a?a=1&b=2"),
    ("https://ex.com/", "https://ex.com/"),
    ("https://ex.com", "https://ex.com/"),
    ("https://ex.com/a?x=1&x=2&y", "https://ex.com/a?x=1&y="),
    ("not a url", "not a url"),
])
def test_normalize_url(spark, raw, expected):
    once = U.normalize_url("u")
    assert value(spark, once, u=raw) == expected
    assert value(spark, once, u=expected) == expected


def test_walk_up(spark):
    up = lambda u: value(spark, U.walk_up("u", "llms.txt"), u=u)
    base = "https://ex.com"
    assert up(base + "/docs/guides/api/page") == [base + p + "llms.txt" for p in ("/docs/guides/api/", "/docs/guides/", "/docs/")]
    assert up(base + "/page") == []
    assert len(up(base + "/a/b/c/d/e/f")) == 3


@pytest.mark.parametrize("href, expected", [
    ("../x", "https://ex.com/a/x"), ("./y", "https://ex.com/a/b/y"), ("../../../z", "https://ex.com/z"), ("//cdn.com/k", "https://cdn.com/k"),
    ("?q=1", "https://ex.com/a/b/c?q=1"), ("#f", "https://ex.com/a/b/c#f"), ("/r/./s/../t", "https://ex.com/r/t"), ("..", "https://ex.com/a/"), ("d", "https://ex.com/a/b/d"),
])
def test_resolve_url(spark, href, expected):
    assert value(spark, U.resolve_url("h", F.lit("https://ex.com/a/b/c")), h=href) == expected


@pytest.mark.parametrize("host, root, docs", [
    ("docs.gitbook.com", "gitbook.com", True), ("developer.amazon.com", "amazon.com", False), ("docs.a.co.uk", "a.co.uk", True), ("a.com", "a.com", False), ("www.docs.b.org", "b.org", True),
])
def test_registrable_domain(spark, host, root, docs):
    assert value(spark, U.registrable_domain("h"), h=host) == root
    assert value(spark, U.is_docs_subdomain("h"), h=host) is docs


# ── robots.txt ──────────────────────────────────────────────────────────

ROBOTS = [
    (None, 13, 0, "accessible", set()),
    ("User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /", 11, 2, "partially_blocked", {"GPTBot", "ClaudeBot"}),
    ("User-agent: *\nDisallow: /", 0, 13, "fully_blocked", set(K.AI_CRAWLERS)),
    ("User-agent: *\nDisallow: /\nAllow: /docs", 13, 0, "accessible", set()),
    ("User-agent: GPTBot\n\nUser-agent: CCBot\nDisallow: /", 12, 1, "partially_blocked", {"CCBot"}),
    ("User-agent: GPTBot\nDisallow: /private", 13, 0, "accessible", set()),
    ("User-agent: gptbot\nDisallow: /", 13, 0, "accessible", set()),
    ("User-agent: GPTBot\nDisallow:", 13, 0, "accessible", set()),
]


def test_robots(spark):
    files = spark.createDataFrame([(f"d{i}", r[0]) for i, r in enumerate(ROBOTS)], "domain string, body string")
    status = R.crawler_status(files).cache()
    blocked = {r.domain: set(r.b) for r in status.filter("blocked").groupBy("domain").agg(F.collect_set("crawler").alias("b")).collect()}
    states = {r.domain: r for r in R.bot_access_state(status).collect()}
    for i, (_, allowed, n, state, names) in enumerate(ROBOTS):
        row = states[f"d{i}"]
        assert (row.allowed, row.blocked, row.state) == (allowed, n, state)
        assert row.allowed + row.blocked == len(K.AI_CRAWLERS)
        assert blocked.get(f"d{i}", set()) == names
    v1 = {(r.domain, r.bot): r.status for r in R.bot_status_v1(files).collect()}
    assert v1["d5", "GPTBot"] == "blocked"
    assert v1["d2", "Bingbot"] == "blocked" and v1["d0", "Bingbot"] == "not-mentioned"
    fold = R.crawler_status(files.filter("domain = 'd6'"), case_insensitive=True)
    assert fold.filter("blocked").count() == 1


# ── pages ───────────────────────────────────────────────────────────────


@pytest.mark.parametrize("html, nested, n", [
    ("<h1>a</h1><h2>b</h2><h3>c</h3>", True, 3), ("<h1>a</h1><h3>c</h3>", False, 2), ("<h2> </h2><h1 id='x'>a</h1>", True, 1), ("<p>none</p>", True, 0), ("<h3>a</h3><h1>b</h1>", True, 2),
])
def test_headings(spark, html, nested, n):
    assert value(spark, H.proper_nesting(H.headings("h")["level"]), h=html) is nested
    assert value(spark, F.size(H.headings("h")), h=html) == n


@pytest.mark.parametrize("ratio, status", [(0.1499, "very-low"), (0.15, "low"), (0.2999, "low"), (0.30, "good")])
def test_ratio_status(spark, ratio, status):
    assert value(spark, H.ratio_status(F.lit(ratio))) == status


def test_open_graph_last_value_wins(spark):
    html = '<meta property="og:title" content="A"><meta property="og:title" content="B"><meta content="C" property="og:type">'
    assert value(spark, H.og_tags("h"), h=html) == {"og:title": "B", "og:type": "C"}
    assert value(spark, H.og_completeness(H.og_tags("h")), h=html) == "partial"


def test_json_ld_skips_broken_blocks(spark):
    html = '<script type="application/ld+json">{"@type": "HowTo", x</script><script type="application/ld+json">{"@type": ["A", "TechArticle"], "n": 1}</script>'
    assert value(spark, H.jsonld_types(H.jsonld_blocks("h")), h=html) == ["A", "TechArticle"]


def test_main_text(spark):
    page = "<body><nav>menu</nav><main id='m'><h1>T</h1><p>one <b>two</b></p><script>x</script></main><article>other</article></body>"
    assert value(spark, H.main_text("h"), h=page) == "T one two"
    assert value(spark, H.main_text("h"), h=page.replace("main", "div")) == "other"
    assert value(spark, H.main_text("h"), h="<p>plain</p>") == "plain"
    assert value(spark, H.main_text("h"), h="<div>" * 3000 + "deep") == "deep"


def test_readable(spark):
    assert value(spark, H.unreadable_reason("m"), m="x" * 99) == "insufficient-content"
    assert value(spark, H.unreadable_reason("m"), m="x" * 100) is None
    assert value(spark, H.unreadable_reason("m"), m="Please wait " + "x" * 100) == "loading-state"


# ── probes and evidence ─────────────────────────────────────────────────


def test_evidence_ladder(spark):
    hint = "struct<llms_hints:array<string>,llms_full_hints:array<string>,md_header_url:string,vary_accept:boolean,x_robots_tag:string>"
    h = lambda urls: (urls, [], None, False, None)
    rows = [(i, f"https://s{i}.com/docs/a/page", "", h([f"https://s{i}.com/h.txt"] if i in (1, 2) else [])) for i in range(5)]
    pages = spark.createDataFrame(rows, f"page_id long, url string, html string, hint {hint}")
    log = spark.createDataFrame(
        [("https://s0.com/llms.txt", "llms.txt", 200, "text/plain"), ("https://s1.com/docs/llms.txt", "llms.txt", 200, "text/plain"),
         ("https://s4.com/llms.txt", "llms.txt", 200, "text/html"), ("https://s0.com/AGENTS.md", "AGENTS.md", 200, "text/plain")],
        "url string, purpose string, status_code int, content_type string",
    )
    llms = spark.createDataFrame([], "base_url string, bucket long, body string")
    robots = spark.createDataFrame([], "base_url string, body string")
    got = {(r.page_id, r.signal): r for r in V.evidence_signals(pages, log, llms, robots).collect()}
    first = {i: (got[i, "llms.txt"].status, got[i, "llms.txt"].method) for i in range(5)}
    assert first == {0: ("verified", "direct-fetch"), 1: ("verified", "subpath-probe"), 2: ("advertised", "link-header"), 3: ("not_verified", "none"), 4: ("not_verified", "none")}
    assert "which gave nothing" in got[1, "llms.txt"].note and "without an answer" in got[3, "llms.txt"].note
    assert got[3, "AGENTS.md"].status == "experimental" and got[3, "AGENTS.md"].validated_url is None
    assert got[0, "AGENTS.md"].validated_url == "https://s0.com/AGENTS.md"
    assert len(got) == 5 * 9
    notes = G.detection_notes(V.evidence_signals(pages, log, llms, robots))
    assert {r.page_id for r in notes.filter("rule = 'agents-file'").collect()} == {0}


def test_link_states(spark):
    t = datetime(2024, 1, 1)
    cases = {"a": [("HEAD", 404, None)], "b": [("HEAD", 405, None), ("GET", 200, None)], "c": [("HEAD", 403, None), ("GET", 403, None)],
             "d": [("HEAD", 0, "timeout"), ("GET", 0, "timeout")], "e": [("HEAD", 0, "error"), ("GET", 500, None)], "f": [("HEAD", 301, None)]}
    rows = [("s", u, m, code, fail, t, i) for u, xs in cases.items() for i, (m, code, fail) in enumerate(xs)]
    log = spark.createDataFrame(rows, "domain string, url string, method string, status_code int, failure string, ts timestamp, event_id int")
    states = P.classify_link(log)
    assert {r.url: r.link_state for r in states.collect()} == {"a": "404", "b": "healthy", "c": "access-denied", "d": "timeout", "e": "error", "f": "healthy"}
    s = P.health_summary(states).first()
    assert s.healthy + s.broken + s.access_denied + s.timeouts + s.other_errors == s.total == 6
    assert s.health_pct == 33


# ── scores ──────────────────────────────────────────────────────────────

BEST = dict(llms_found=True, sitemap_found=True, has_canonical=True, blocks_indexing=False, markdown_found=True, markdown_discoverable=True, h1_count=1, proper_nesting=True,
            js_rendered=False, words=800, density_status="good", has_jsonld=True, valid_schema=True, schema_status="complete", og_status="complete", has_breadcrumbs=True)


def score(spark, **changes):
    row = {**BEST, **changes}
    return G.readiness_scores(spark.createDataFrame([row])).withColumn("grade", G.grade(F.col("overall"))).first()


def test_score_limits(spark):
    top = score(spark)
    assert (top.discoverability, top.consumability, top.structured, top.overall, top.grade) == (40, 40, 20, 100, "A+")
    worst = score(spark, llms_found=False, sitemap_found=False, has_canonical=False, blocks_indexing=True, markdown_found=False)
    assert worst.discoverability == -5


@pytest.mark.parametrize("words, points", [(299, 0), (300, 3), (499, 3), (500, 6), (2000, 6), (2001, 3)])
def test_word_count_points(spark, words, points):
    assert score(spark, words=words).consumability == 34 + points


@pytest.mark.parametrize("total, grade", [(95, "A+"), (94, "A"), (90, "A"), (89, "B+"), (85, "B+"), (84, "B"), (75, "B"), (74, "C"), (60, "C"), (59, "D"), (40, "D"), (39, "F")])
def test_grades(spark, total, grade):
    assert value(spark, G.grade(F.lit(total))) == grade


def test_weights():
    for weights in K.CONTENT_TYPE_WEIGHTS.values():
        assert abs(sum(weights) - 1) < 1e-9


def test_weighted_overall_and_penalty(spark):
    dims = spark.createDataFrame([("p", "relevance", 80.0, "mixed"), ("p", "clarity", 60.0, "mixed"), ("p", "accuracy", None, "mixed"), ("q", "clarity", None, "mixed")], "page string, dimension string, score double, content_type string")
    got = {r.page: r.overall for r in G.weighted_overall(G.apply_weights(dims)).collect()}
    assert got == {"p": 69, "q": None}
    assert value(spark, G.slug_penalty(F.lit(6), F.lit(0))) == 25
    low = G.penalise_clarity(dims, spark.createDataFrame([("p", 25)], "page string, penalty int"))
    assert low.filter("page = 'p' AND dimension = 'clarity'").first().score == 35


# ── citations ───────────────────────────────────────────────────────────


def test_citations(spark):
    rows = [(1, "https://docs.ex.com/a", 0, "high", 0, "https://ex.com/blog"), (2, "https://developer.ex.com/a", 0, "high", 0, "https://ex.com/blog"), (3, "https://ex.com/a", 0, "high", 0, "https://notex.com/")]
    got = {r.page_id: r.cited for r in C.cited(spark.createDataFrame(rows, "page_id long, target_url string, query_pos int, tier string, pos int, cited_url string")).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert [value(spark, C.citation_tier(F.lit(x))) for x in (0.6, 0.4, 0.2, 0.0)] == ["high", "partial", "low", "not-found"]


# ── issues ──────────────────────────────────────────────────────────────


def test_issue_status(spark):
    rows = [(2, 1, 0.9, True, True, []), (3, 1, 0.7, True, True, ["g"]), (4, 1, 0.3, True, True, ["g"]), (5, 1, 0.3, True, False, ["g"]), (6, 1, 0.7, True, False, ["g"]), (7, 1, 0.9, False, False, [])]
    ev = spark.createDataFrame(rows, "issue_id long, page_id long, similarity double, loaded boolean, relevant boolean, gaps array<string>")
    issues = spark.createDataFrame([(i,) for i in range(1, 8)], "issue_id long")
    got = {r.issue_id: (r.status, r.confidence) for r in I.issue_status(issues, ev).collect()}
    assert got == {1: ("critical-gap", 95), 2: ("resolved", 90), 3: ("potential-gap", 75), 4: ("confirmed", 70), 5: ("critical-gap", 85), 6: ("potential-gap", 75), 7: ("critical-gap", 85)}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_keyword_page_match_brute_force(spark, seed):
    """Rare, common and absent words, repeated word sets, sites with few URLs, URLs that differ in case only."""
    rng = random.Random(seed)
    vocab = ["api", "guide", "docs", "deploy", "authentication", "key", "web", "hook", "webhooks", "email", *(f"rare{i}" for i in range(6))]
    part = lambda: "-".join(rng.sample(vocab, rng.randint(1, 4)))
    urls = {(s, f"https://{s}.com/{'docs/' if rng.random() < 0.3 else ''}{part()}/{i}") for i in range(90) for s in ("s", "t")}
    urls = sorted(urls | {("s", u.upper()) for s, u in sorted(urls)[:5]} | {("few", "https://few.com/docs/api"), ("few", "https://few.com/x")})
    issues = [(i, rng.choice(["s", "t", "few", "none"]), rng.sample(vocab + ["absent", "https", "com"], rng.randint(0, 7))) for i in range(60)]
    issues += [(100 + i, "s", ["https", "com"]) for i in range(30)]
    got = I.keyword_page_match(spark.createDataFrame(issues, "issue_id long, site string, keywords array<string>"), spark.createDataFrame(urls, "site string, url string"))
    got = sorted((r.issue_id, r["rank"], r.url, float(r.score)) for r in got.collect())
    want = []
    for i, site, words in issues:
        scored = sorted((-(sum(w in u.lower() for w in words) + 0.5 * ("/docs/" in u.lower())), u) for s, u in urls if s == site)
        want += [(i, n + 1, u, -s) for n, (s, u) in enumerate(x for x in scored[:5] if x[0] < 0)]
    assert got == sorted(want)


@pytest.mark.parametrize("block", [3, 1000])
def test_similar_pages_brute_force(spark, block):
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(10, 6)), rng.normal(size=(25, 6))
    p[4] = 0
    to = lambda m, name: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>")
    got = {(r.issue_id, r["rank"]): (r.page_key, r.similarity) for r in I.similar_pages(to(q, "issue_id"), to(p, "page_key"), k=4, block=block).collect()}
    norm = np.linalg.norm(p, axis=1)
    for i, v in enumerate(q):
        sims = np.divide(p @ v, norm * np.linalg.norm(v), out=np.zeros(len(p)), where=norm > 0)
        order = np.argsort(-sims, kind="stable")[:4]
        assert [got[i, n + 1][0] for n in range(4)] == list(order)
        assert abs(got[i, 1][1] - sims[order[0]]) < 1e-6


def test_relevant_docs_counts_repeats(spark):
    issues = spark.createDataFrame([(1, "r", "alpha1 alpha1 beta22 gamma3", None), (2, "r", "alpha1 beta22 delta4", None)], "number long, repo string, title string, body string")
    docs = spark.createDataFrame([(10, "r", "xalpha1y and beta22."), (11, "r", "gamma3 beta22 alpha1"), (12, "q", "alpha1 beta22 gamma3")], "doc_id long, repo string, content string")
    assert {(r.number, r.doc_id, r.matches) for r in I.relevant_docs(issues, docs).collect()} == {(1, 11, 4)}


def test_docs_related(spark):
    df = spark.createDataFrame([("bug", "x", ["Docs"]), ("The README lies", None, []), ("x", "this is not clear", []), ("crash", "boom", ["bug"])], "t string, b string, l array<string>")
    assert [r[0] for r in df.select(I.docs_related("t", "b", "l")).collect()] == [True, True, True, False]


# ── fixes ───────────────────────────────────────────────────────────────


def test_apply_fixes(spark):
    docs = spark.createDataFrame([(1, "The quick  brown\nfox jumps, over; the lazy dog. The quick")], "doc_id long, content string")
    fixes = [
        (1, 0, "exact", "lazy dog", "sleepy $1 dog"), (1, 1, "space", "quick brown fox", "slow fox"), (1, 2, "fuzzy", "jumps over the sleepy", "rests near the"),
        (1, 3, "short", "no such", "x"), (1, 4, "chained", "slow fox rests", "fox sleeps"),
    ]
    f = spark.createDataFrame(fixes, "doc_id long, pos int, fix_id string, original string, proposed string")
    row = X.apply_fixes(docs, f).first()
    assert {o.fix_id: o.strategy for o in row.outcomes} == {"exact": "exact", "space": "whitespace", "fuzzy": "tokens", "short": None, "chained": "exact"}
    assert row.content == "The fox sleeps near the $1 dog. The quick"
    some = X.apply_fixes(docs, f, spark.createDataFrame([("exact",)], "fix_id string")).first()
    assert some.content.startswith("The quick  brown\nfox") and "sleepy $1 dog" in some.content


def test_fixes_without_a_text(spark):
    """A null original is not applied and later fixes still are; quotes of the pattern language are literal."""
    docs = spark.createDataFrame([(1, r"keep a\Eb (c)  d. tail")], "doc_id long, content string")
    fixes = [(1, 0, "null", None, "x"), (1, 1, "odd", r"a\Eb  (c) d.", "y"), (1, 2, "gone", "tail", None), (1, 3, "blank", "   ", "z")]
    row = X.apply_fixes(docs, spark.createDataFrame(fixes, "doc_id long, pos int, fix_id string, original string, proposed string")).first()
    assert {o.fix_id: o.strategy for o in row.outcomes} == {"null": None, "odd": "whitespace", "gone": "exact", "blank": None}
    assert row.content == "keep y "


# ── usage ───────────────────────────────────────────────────────────────


def usage(spark, moves):
    rows = [(i, "ip", datetime(2024, 1, 1, 0, 0, 20 * i % 60, 0) if i < 3 else datetime(2024, 1, 1, 1, i), d) for i, d in enumerate(moves)]
    return O.daily_usage(spark.createDataFrame(rows, "event_id long, ip_hash string, ts timestamp, delta int"))


@pytest.mark.parametrize("moves, used", [([1, 1, -1], 1), ([-1, 1], 1), ([1, 1, 1], 3), ([-1, -1, -1, 1, 1, -1, -1, -1, 1], 1), ([1, -1, -1, 1, 1, 1], 3)])
def test_daily_usage(spark, moves, used):
    assert usage(spark, moves).first().used == used


def test_rate_decision(spark):
    used = usage(spark, [1, 1, 1])
    none, one = spark.createDataFrame([], "ip_hash string"), spark.createDataFrame([("ip",)], "ip_hash string")
    a, b = O.rate_decision(used, none).first(), O.rate_decision(used, one).first()
    assert (a.allowed, a.remaining) == (False, 0)
    assert (b.allowed, b.remaining) == (True, 7)


# ── stores and readers ──────────────────────────────────────────────────


def test_upsert_is_idempotent(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    kb = spark.createDataFrame([("ex-com", "https://ex.com/a", "old", datetime(2024, 1, 1), datetime(2024, 1, 8))], "domain string, url string, title string, crawled_at timestamp, expires_at timestamp")
    new = spark.createDataFrame([("https://ex.com/a", "new", datetime(2024, 1, 2)), ("https://b.ex.com/c", "c", datetime(2024, 1, 1))], "url string, title string, crawled_at timestamp")
    once = ST.upsert_kb(kb, new, now)
    twice = ST.upsert_kb(once, new, now)
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect())) and len(rows) == 2
    assert {r[1]: r[2] for r in rows} == {"https://ex.com/a": "new", "https://b.ex.com/c": "c"}


def test_curated_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"acme": [{"id": "1", "title": "T", "frequency": 3, "lastSeen": "2024-01-01"}, {"id": "2"}],\n "metadata": {"n": 2}}')
    rows = RD.read_curated_issues(spark, str(tmp_path / "c.json")).orderBy("id").collect()
    assert [(r.company, r.id, r.frequency) for r in rows] == [("acme", "1", 3), ("acme", "2", None)]
    assert value(spark, RD.company_key(F.lit(""), "d"), d="docs.knock.app") == "knock"
    assert value(spark, RD.company_key(F.lit(None), "d"), d="Acme.io") == "acme"


def test_issue_file(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"number": 1, "title": "a", "body": null, "labels": [{"name": "x"}], "state": "open"}\n{"number": 2, "title": "b", "pull_request": {"url": "u"}}\n')
    rows = RD.read_issues(spark, str(tmp_path / "i.json")).collect()
    assert [(r.number, r.body, r.labels, r.comments, r.reactions) for r in rows] == [(1, "", ["x"], 0, 0)]


def test_model_json(spark):
    got = lambda t: value(spark, M.json_text("t"), t=t)
    assert got('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert got('text {"a": {"b": 2}} tail') == '{"a": {"b": 2}}'
    assert got("nothing") is None


# ── building blocks ─────────────────────────────────────────────────────


def test_number_rows_and_top_k(spark):
    ids = [i * i for i in range(500)]
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids, len(ids))], "id long")
    got = {r.id: r.n for r in number_rows(df, "id", "n").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(ids))}
    hot = spark.range(5000).select(F.lit("k").alias("key"), "id")
    assert [r.id for r in top_k(hot, ["key"], [F.col("id").desc()], 3, ["id"]).orderBy("rank").collect()] == [4999, 4998, 4997]


def test_sitemap_depth(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    leaf = lambda u: f"<urlset xmlns='x'><url><loc>{u}</loc></url></urlset>"
    s = "https://s.com/"
    files = [(s + "0", index(s + "1", s + "0")), (s + "1", index(s + "2", s + "l1")), (s + "2", index(s + "3")), (s + "3", index(s + "4")), (s + "4", leaf(s + "deep")), (s + "l1", leaf(s + "page"))]
    got = S.expand_sitemap_index(spark.createDataFrame([(s + "0",)], "url string"), spark.createDataFrame(files, "url string, body string"))
    assert {(r.url, r.depth) for r in got.collect()} == {(s + "page", 2)}
    late = S.unopened_sitemaps(spark.createDataFrame([(s + "0",)], "url string"), spark.createDataFrame(files, "url string, body string"))
    assert [tuple(r) for r in late.collect()] == [(s + "0", s + "4")]


def test_sitemap_fixpoint(spark):
    """A chain of twelve index files, a cycle back to its start, and a second root inside the chain."""
    name = lambda i: f"https://s.com/{i}"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    files = [(name(i), index(name(i + 1), name(0), name(f"l{i}"))) for i in range(12)]
    files += [(name(f"l{i}"), f"<urlset><url><loc>{name(f'page{i % 7}')}</loc></url></urlset>") for i in range(12)] + [(name(12), index(name(3)))]
    roots, files = spark.createDataFrame([(name(0),), (name(9),), (name(9),)], "url string"), spark.createDataFrame(files, "url string, body string")
    got = {(r.root, r.url): r.depth for r in S.expand_sitemap_index(roots, files, None).collect()}
    want = {(name(0), name(f"page{i}")): i + 1 for i in range(7)}
    # from 9 on: 9, 10, 11, then back to 0 (one step) and to 3 (four steps)
    want |= {(name(9), name(f"page{p}")): d for p, d in {2: 1, 3: 2, 4: 3, 0: 2, 1: 3, 5: 7, 6: 8}.items()}
    assert got == want


def test_no_cut_of_sitemaps_and_lists(spark):
    body = "<urlset>" + "".join(f"<url><loc>https://s.com/{i}</loc></url>" for i in range(700)) + "</urlset>"
    files = spark.createDataFrame([("https://s.com/m", body)], "url string, body string")
    assert S.sitemap_urls(files).count() == 700 and S.sitemap_urls(files, 500).count() == 500
    assert S.expand_sitemap_index(files.select("url"), files).count() == 700


def in_batches(spark, tmp_path, rows, schema, n):
    """The rows as a stream of ``n`` files, one for each micro-batch, in the order of time."""
    folder = str(tmp_path / f"in-{n}")
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_do_not_depend_on_batches(spark, tmp_path):
    from datetime import timedelta

    from doccensus.streaming import jobs as J

    start = datetime(2024, 1, 1, 8)
    asked = [(start + timedelta(days=k * 1.5), f"https://x.com/{k % 3}", "with-context") for k in range(30)]
    moves = [(k, f"ip{k % 2}", start + timedelta(hours=5 * k), [-1, 1, 1, -1, -1, 1][k % 6]) for k in range(40)]
    got = []
    for n in (1, 5):
        first = J.first_requests_stream(in_batches(spark, tmp_path / "a", asked, "ts timestamp, url string, contextual_setting string", n))
        used = J.daily_usage_stream(in_batches(spark, tmp_path / "b", moves, "event_id long, ip_hash string, ts timestamp, delta int", n))
        got.append((sorted(map(tuple, J.drain_to_table(first, "a").collect())), sorted(map(tuple, J.drain_to_table(used, "b").collect()))))
    assert got[0] == got[1]
    # every key is asked each 4.5 days, so every second request is made anew
    assert len(got[0][0]) == 15
    whole = {(r.ip_hash, r.day): r.used for r in O.daily_usage(spark.createDataFrame(moves, "event_id long, ip_hash string, ts timestamp, delta int")).collect()}
    assert got[0][1] and all(whole[ip, day] == used for ip, day, used in got[0][1])


def test_store_upsert_keeps_other_domains(spark, tmp_path):
    from doccensus.streaming import jobs as J

    path, now = str(tmp_path / "kb"), F.lit(datetime(2024, 2, 1))
    batch = lambda rows: spark.createDataFrame([(u, t, datetime(2024, 1, d)) for u, t, d in rows], "url string, title string, crawled_at timestamp")
    merge = J.upsert_kb_sink(path, now)
    merge(batch([("https://a.com/1", "old", 1), ("https://b.com/1", "b", 1)]), 0)
    for _ in range(2):  # a repeated batch changes nothing
        merge(batch([("https://a.com/1", "new", 2), ("https://a.com/2", "two", 2)]), 1)
    rows = {(r.url, r.title) for r in J.read_current_kb(spark, path).collect()}
    assert rows == {("https://a.com/1", "new"), ("https://a.com/2", "two"), ("https://b.com/1", "b")}


def test_store_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    """One page written into a domain of 400 pages leaves the files of all other buckets as they were."""
    from doccensus.streaming import jobs as J

    path, now = tmp_path / "kb", F.lit(datetime(2024, 2, 1))
    batch = lambda rows: spark.createDataFrame([(u, t, datetime(2024, 1, d)) for u, t, d in rows], "url string, title string, crawled_at timestamp")
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    merge = J.upsert_kb_sink(str(path), now)
    merge(batch([(f"https://a.com/{i}", "old", 1) for i in range(400)] + [("https://b.com/1", "b", 1)]), 0)
    before = files()
    merge(batch([("https://a.com/7", "new", 2)]), 1)
    after = files()
    gone = {f.rsplit("/", 1)[0] for f in before if f not in after}
    assert len(gone) == 1 and len({f.split("/")[1] for f in before}) == ST.BUCKETS
    assert all(after[f] == before[f] for f in before if f in after)
    rows = J.read_current_kb(spark, str(path))
    assert rows.count() == 401 and rows.filter("title = 'new'").count() == 1
    assert ST.read_kb(spark, str(path), "a-com", F.lit(datetime(2024, 1, 9))).count() == 400


def test_cache_is_judged_at_the_request(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    made = [("https://x.com/a", "w", at(2), at(4)), ("https://x.com/a", "w", at(6), at(20)), ("https://x.com/a", "w", at(8), at(9)), (None, "w", at(1), at(30))]
    asked = [(1, at(1)), (2, at(2)), (3, at(4)), (4, at(4, 1)), (5, at(7)), (6, at(8)), (7, at(10))]
    rows = [(i, "HTTPS://X.com/a/#top", "w", t) for i, t in asked] + [(8, "https://x.com/a", "v", at(3)), (9, None, "w", at(3))]
    got = ST.split_cached_at(
        spark.createDataFrame(rows, "event_id long, url string, contextual_setting string, ts timestamp"),
        spark.createDataFrame(made, "url string, contextual_setting string, processed_at timestamp, ttl timestamp"),
    )
    assert {r.event_id for r in got.filter("cache_status = 'hit'").collect()} == {2, 3, 5, 6} and got.count() == 9


def test_sitemap_state_stream(spark, tmp_path):
    """Late rows change their own day; the newest by event time counts, whatever the batches."""
    from datetime import timedelta

    from doccensus.streaming import jobs as J

    start, rng = datetime(2024, 1, 1), random.Random(2)
    rows = [(k, start + timedelta(hours=3 * k + rng.randrange(-10, 10)), "d", f"u{k % 5}", rng.choice(["HEAD", "HEAD", "GET"]), rng.choice([200, 404, 403, 500, 0]), None) for k in range(60)]
    schema = "event_id long, ts timestamp, domain string, url string, method string, status_code int, failure string"
    want = sorted(map(tuple, P.classify_sitemap_url(spark.createDataFrame(rows, schema)).collect()))
    for n in (1, 12):
        updates = J.drain_updates(J.latest_heads_stream(in_batches(spark, tmp_path, rows, schema, n)), "heads", ["domain", "url", "since"])
        assert sorted(map(tuple, P.classify_sitemap_url(J.latest_heads(updates)).collect())) == want


def test_limits_of_posts_are_parameters(spark):
    post = "".join(f'<div class="s-prose js-post-body" itemprop="text">answer {i} is long enough</div></div>' for i in range(6))
    code = "".join(f"<pre><code>{'x' * (30 + i)}</code></pre>" for i in range(7)) + f"<pre><code>{'y' * 2000}</code></pre>"
    size = lambda column, **cells: value(spark, F.size(column), **cells)
    assert (size(H.post_bodies("h"), h=post), size(H.post_bodies("h", None), h=post)) == (3, 6)
    assert (size(H.post_code_snippets("h"), h=code), size(H.post_code_snippets("h", None, None), h=code)) == (5, 8)
    assert value(spark, F.length(H.code_snippets("h", None)[7]["code"]), h=code) == 2000
    assert value(spark, F.length(H.code_snippets("h")[7]["code"]), h=code) == 1000
    errors = " ".join(f"<p>Error: number {i} has happened here</p>\n" for i in range(5))
    assert (size(H.error_messages("h"), h=errors), size(H.error_messages("h", None), h=errors)) == (3, 5)


def test_platform_fingerprints(spark):
    names = lambda page: [x for x in value(spark, H.doc_signals("h", F.lit("https://x.com/a"))["name"], h=page) if x.startswith(("doc ", "API "))]
    assert names("<div class='docusaurus'>") == ["doc framework detected"]
    assert names("<div id='swagger-ui'>") == ["API doc framework"]
    assert names("<div class='mintlify docusaurus' id='swagger-ui'>") == ["doc platform fingerprint"]


def test_doubtful_slug_findings_cost_too(spark):
    from doccensus.plans import scoring_queries as SC

    rows = {r["page"]: r["penalty"] for r in SC._penalties(spark, "/root/testdata/sf0.001").filter("page IN (2, 6, 8, 14)").collect()}
    # 2: two doubtful ones; 6: a certain one reported six times, at most 25
    assert rows == {2: 6, 6: 25, 8: 6, 14: 25}


def test_store_upsert_of_equal_times_has_one_result(spark):
    at = datetime(2024, 1, 1)
    rows = [("example-com", "https://example.com/a", t, at, at) for t in ("b", "c", "a")]
    schema = "domain string, url string, title string, crawled_at timestamp, expires_at timestamp"
    none = spark.createDataFrame([], "url string, title string, crawled_at timestamp")
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        kept = ST.upsert_kb(spark.createDataFrame(order, schema).coalesce(1), none, F.lit(at)).collect()
        assert [r["title"] for r in kept] == ["c"]


def test_stream_of_a_folder_of_files(spark, tmp_path):
    from doccensus.plans import streams_queries as SQ

    spark.range(6).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "events.parquet")
    for table, n in (("pages", 6), ("events", 4)):
        name = f"stream_of_{table}"
        SQ.stream(spark, str(tmp_path), table).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == n
