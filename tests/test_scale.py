"""Hot keys, pruned searches and work that must not grow with what it skips."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from doccensus.functions.common import rank_within, running_totals
from doccensus.operators import evidence as E
from doccensus.operators import issues as I
from doccensus.operators import vector_index as VI


@pytest.fixture
def many_parts(spark):
    """Small tables keep their shuffle partitions, as large ones would."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _hot(spark):
    """A third of the rows under one key, some under a null key, ties in the order."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 11)
    return spark.range(24_000).select(key.alias("k"), (F.hash("id") % 5000).alias("o"), "id")


def test_rank_within_equals_a_window(many_parts):
    order = [F.col("o").desc(), F.col("id")]
    ranked = rank_within(_hot(many_parts), ["k"], order)
    plain = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    assert ranked.count() == 24_000
    assert ranked.withColumn("plain", plain).filter("plain <> rank").isEmpty()


def test_rank_within_splits_a_hot_key(many_parts):
    ranked = rank_within(_hot(many_parts), ["k"], [F.col("o"), F.col("id")])
    shares = [r[0] for r in ranked.filter("k = 7").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(shares) > 3 and max(shares) < 24_000 / 6


def test_running_totals(many_parts):
    rows = _hot(many_parts).withColumn("v", F.col("id") % 17 - 5)
    got = running_totals(rows, ["k"], [F.col("o"), F.col("id")], total=F.col("v"), n=F.lit(1))
    upto = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert got.withColumn("plain", F.sum("v").over(upto)).filter("plain <> total").isEmpty()
    assert running_totals(rows.limit(0), ["k"], [F.col("o")], total=F.col("v")).count() == 0


# ── vector index ────────────────────────────────────────────────────────


def _frame(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, embedding array<double>")


def _closest(q, p, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = np.round(unit(q) @ unit(p).T, 9)
    return {(i, n + 1): (int(j), sims[i, j]) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(p)), -sims[i]))[:k])}


def _grouped(rng, n, groups=20, dims=24, noise=0.15):
    middle = rng.normal(size=(groups, dims))
    return middle[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims))


@pytest.mark.parametrize("kind", ["grouped", "plain", "odd"])
def test_index_search_is_exact(spark, kind):
    rng = np.random.default_rng(11)
    if kind == "grouped":
        both = _grouped(rng, 900)
        q, p = both[:100], both[100:]
    elif kind == "plain":
        q, p = rng.normal(size=(60, 16)), rng.normal(size=(400, 16))
    else:  # ties by the hundred, zero vectors on both sides, fewer pages than k in most cells
        p = np.concatenate([np.repeat(rng.normal(size=(3, 4)), 60, axis=0), np.zeros((5, 4)), rng.normal(size=(4, 4))])
        q = np.concatenate([rng.normal(size=(20, 4)), np.zeros((2, 4)), p[:2]])
    got = I.similar_pages(_frame(spark, q, "issue_id"), _frame(spark, p, "page_key"), k=6, block=64).collect()
    found = {(r["issue_id"], r["rank"]): (r["page_key"], round(r["similarity"], 9)) for r in got}
    want = _closest(q, p, 6)
    assert {x: v[1] for x, v in found.items()} == pytest.approx({x: v[1] for x, v in want.items()}, abs=2e-9)
    if kind != "odd":
        assert {x: v[0] for x, v in found.items()} == {x: v[0] for x, v in want.items()}


def test_index_compares_few_vectors(spark):
    """Vectors in groups: nearly all cells are ruled out by their bound."""
    both = _grouped(np.random.default_rng(5), 3000)
    q, index = _frame(spark, both[:200], "issue_id"), VI.build_index(_frame(spark, both[200:], "page_key"))
    near = VI.search(q, index, 5)
    reached = near.groupBy("issue_id").agg(F.min("similarity").alias("reached"))
    seen = [VI.visits(q, index, 5), VI.visits(q, index, 5, reached)]
    size = dict(zip(index.grid.cells.tolist(), index.grid.sizes.tolist(), strict=True))
    compared = sum(size[r["cell"]] for v in seen for r in v.select("cell").collect())
    assert compared < 0.2 * 200 * 2800


def test_index_of_nothing(spark):
    none, some = _frame(spark, [], "page_key"), _frame(spark, [[1.0, 0.0]], "issue_id")
    assert I.similar_pages(some, none).count() == 0
    assert I.similar_pages(_frame(spark, [], "issue_id"), _frame(spark, [[1.0, 0.0]], "page_key")).count() == 0


def test_vectors_of_unequal_length_are_an_error(spark):
    with pytest.raises(Exception):
        I.similar_pages(_frame(spark, [[1.0, 0.0]], "issue_id"), _frame(spark, [[1.0, 0.0], [1.0, 2.0, 3.0]], "page_key")).collect()


# ── overlap join ────────────────────────────────────────────────────────


@pytest.mark.parametrize("chunk", [4096, 3])
def test_relevant_docs_brute_force(spark, chunk):
    """Words that nearly all documents hold, repeats, issues below the threshold, words inside longer tokens, two repositories."""
    import random

    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(40)] + ["commonest", "commoner"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "x"]) for _ in range(n))
    issues = [(i, f"r{i % 2}", text(rng.randrange(0, 9)), rng.choice([None, "commonest commoner commonest", text(3)])) for i in range(50)]
    docs = [(i, f"r{i % 2}", rng.choice(["", "commonest "]) + text(rng.randrange(0, 25))) for i in range(60)] + [(99, "r0", None)]
    got = I.relevant_docs(
        spark.createDataFrame(issues, "number long, repo string, title string, body string"), spark.createDataFrame(docs, "doc_id long, repo string, content string"), chunk=chunk
    )
    want = set()
    for n, repo, title, body in issues:
        words = [w for w in f"{title} {body or ''}".lower().split() if len(w) > 4]
        for d, other, content in docs:
            hits = sum(w in (content or "").lower() for w in words)
            if repo == other and hits > 3:
                want.add((n, d, hits))
    assert {tuple(r) for r in got.collect()} == want and want


def test_index_search_over_many_partitions(many_parts):
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(40, 8)), rng.normal(size=(600, 8))
    got = VI.search(_frame(many_parts, q, "issue_id"), VI.build_index(_frame(many_parts, p, "page_key")), 5)
    want = _closest(q, p, 5)
    assert {(r["issue_id"], r["rank"]): r["page_key"] for r in got.collect()} == {k: v[0] for k, v in want.items()}


def test_common_words_by_join_and_by_product():
    rng = np.random.default_rng(8)
    bag = lambda n: [np.sort(rng.choice(300, size=rng.integers(1, 40), replace=False)) for _ in range(n)]
    q, p = bag(30), bag(50)
    m = [rng.integers(1, 3, len(x)) for x in q]
    want = {(i, j, n) for i, x in enumerate(q) for j, y in enumerate(p) if (n := int(m[i][np.isin(x, y)].sum())) >= 4}
    asked = pd.DataFrame({"number": range(30), "ws": q, "ms": m})
    held = pd.DataFrame({"doc_id": range(50), "ws": p})
    for width, few in ((2048, 10**9), (7, 0), (64, 12)):
        assert {tuple(int(x) for x in r) for r in I._common_words(asked, held, 4, width, few).itertuples(index=False)} == want



def test_to_crawl_brute_force(spark):
    """Lists shared by a section against every target held against every entry; odd paths among them."""
    from doccensus.operators import sitefiles as S

    paths = ["", "/", "/docs", "/docs/", "/docs/a", "/docs/a/b", "/docs/ab", "/docs/a/b/c", "//x/y", "/docs//z", "/blog?p=1", "/blog?p=2"]
    strip = lambda p: (p.split("?")[0] or "/").removesuffix("/")
    parent = lambda p: "/" + "/".join([x for x in p.split("/") if x][:-1])
    base = "https://a.org"
    entries = [(base + p, i % 2, i) for i, p in enumerate(paths)] + [(base + "/docs", 1, 90), ("https://b.org/docs", 0, 5)]
    got = S.to_crawl(
        spark.createDataFrame(entries, "url string, bucket long, pos long"), spark.createDataFrame([(base + p,) for p in paths], "target_url string"),
        spark.createDataFrame([(base + "/docs/ab",)], "url string"),
    )
    want = set()
    for p in paths:
        own = strip(p)
        held = {(b, n, u) for u, b, n in entries if u != base + "/docs/ab" and u.startswith(base) and (strip(u[13:]).startswith(parent(own)) or own.startswith(strip(u[13:])))}
        want |= {(base + p, *e, i + 1) for i, e in enumerate(sorted(held))}
    assert {tuple(r) for r in got.select("target_url", "bucket", "pos", "url", "rank").collect()} == want


# ── nothing that grows comes to the driver ──────────────────────────────


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_index_is_not_broadcast(spark):
    texts = spark.createDataFrame([("s", "https://x.org/docs/guide"), ("s", "https://x.org/blog")], "site string, text string")
    words = spark.createDataFrame([("s", "guide"), ("s", "blog"), ("s", "absent"), ("t", "blog")], "site string, kw string")
    found = I.contained_words(words, texts, "site", "kw", "text")
    assert "BroadcastExchange" not in _plan(found)
    assert {tuple(r) for r in found.collect()} == {("s", "guide", "https://x.org/docs/guide"), ("s", "blog", "https://x.org/blog")}


def test_page_probes_are_not_broadcast(spark, tmp_path):
    harvested = spark.createDataFrame([(1, [("llms", "llms.txt", "https://a.org/llms.txt", "", 0)])], "page_id long, asked array<struct<slot:string,purpose:string,url:string,source:string,prio:int>>")
    harvested.write.parquet(str(tmp_path / "h"))
    log = spark.createDataFrame([("https://a.org/llms.txt", "llms.txt", 200, 5, "text/plain")], "url string, purpose string, status_code int, duration_ms long, content_type string")
    made = E.page_probe_log(None, log, None, None, harvested=spark.read.parquet(str(tmp_path / "h")))
    assert "BroadcastExchange" not in _plan(made)
    assert [tuple(r) for r in made.collect()] == [(1, "https://a.org/llms.txt", "llms.txt", 200, 5)]


def _broadcast_rows(df):
    """Schemas of the tables that a plan broadcasts."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.initialPlan())
        if p.nodeName() == "BroadcastExchange":
            found.append(p.schema().simpleString())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_words_of_urls_are_not_broadcast(spark, monkeypatch):
    """Word lists, many times their compressed size, stay out of the driver in every step of the match."""
    plans, plain = [], I.settled
    monkeypatch.setattr(I, "settled", lambda df: plans.extend(_broadcast_rows(df)) or plain(df))
    urls = [("s", f"https://x.org/{'docs/' if i % 2 else ''}guide{i % 3}/word{i}") for i in range(12)]
    asked = [(1, "s", ["guide", "word1", "docs"]), (2, "s", ["absent"]), (3, "t", ["guide"]), (4, "s", ["word11", "org", "guide2"])]
    got = I.keyword_page_match(spark.createDataFrame(asked, "issue_id long, site string, keywords array<string>"), spark.createDataFrame(urls, "site string, url string"), k=3)
    want = set()
    for n, site, words in asked:
        scores = [(sum(w in u for w in words) + 0.5 * ("/docs/" in u), u) for s, u in urls if s == site]
        want |= {(n, u, x, i + 1) for i, (x, u) in enumerate(sorted([p for p in scores if p[0] > 0], key=lambda p: (-p[0], p[1]))[:3])}
    assert {tuple(r) for r in got.collect()} == want
    assert not [x for x in plans + _broadcast_rows(got) if "array" in x]


def test_texts_to_fix_are_not_gathered(spark):
    """Texts that compress to next to nothing stay dealt over the session's partitions."""
    from doccensus.operators import fixes as X

    pages = spark.range(4000).select(F.col("id").alias("page"))
    findings, actions = pages.select("page", F.lit("same").alias("finding")), pages.select("page", F.explode(F.array(F.lit("same"), F.lit("other"))).alias("action"))
    got = X.issues_to_fix(findings, actions, pages.filter("page % 5 = 0").select("page", F.lit("picked").alias("text")))
    assert got.filter("page % 5 <> 0").groupBy(F.spark_partition_id()).count().count() >= 8
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((p, t) for p in range(4000) for t in (["picked"] if p % 5 == 0 else ["same", "other"]))


def test_squashing_scans_a_text_once(spark):
    """White space of all kinds, at both ends too, by one pattern."""
    from doccensus.functions.common import squash_ws

    texts = ["", " ", " a  b\t\n", "\r\n\x0b\x0ca \x0b b", "a", None, "  a  ", "\n" * 5 + "a b" + " " * 9]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", squash_ws(F.col("t")).alias("t"))
    import re

    assert dict(got.collect()) == {i: None if t is None else re.sub(r"^ | $", "", re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t)) for i, t in enumerate(texts)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_issue_status_broadcasts_nothing(spark, monkeypatch):
    """No table of any size comes to the driver on the way to the status of an issue, the events least of all."""
    from doccensus.plans import issues_queries as Q

    plans, plain = [], I.settled
    for module in (I, Q):
        monkeypatch.setattr(module, "settled", lambda df: plans.extend(_broadcast_rows(df)) or plain(df))
    summary = Q.QUERIES["i12_status_summary"](spark, "/root/testdata/sf0.001")
    assert plans + _broadcast_rows(summary) == []
    assert summary.count() == 1


def test_page_match_keeps_no_pairs(spark, monkeypatch):
    """Many URLs that tie: a set writes its best classes of a block, in any number of blocks, not every class it meets."""
    import random

    made, plain = [], I.settled

    def counted(df):
        made.append((df.columns, (out := plain(df)).count()))
        return out

    monkeypatch.setattr(I, "settled", counted)
    rng = random.Random(3)
    urls = [(f"s{i % 2}", f"https://x.org/{rng.choice(['docs', 'Docs', 'blog'])}/{'-'.join(rng.sample(['alpha', 'beta', 'gamma', 'delta'], 2))}/p{i}") for i in range(300)]
    words = ["alpha", "beta", "gamma", "delta", "p11", "p27", "docs", "two words", "g/b", "p299"]
    asked = [(i, f"s{rng.randrange(3)}", rng.sample(words, rng.randrange(6))) for i in range(60)] + [(7, "s0", ["p44", "alpha"]), (None, "s1", ["alpha"]), (99, None, ["alpha"]), (98, "s0", None)]
    frames = spark.createDataFrame(asked, "issue_id long, site string, keywords array<string>"), spark.createDataFrame(urls, "site string, url string")
    of = {}
    for n, site, ws in asked:
        of.setdefault((n, site), set()).update(ws or () if n is not None else ())
    want = []
    for n, site, _ in asked:
        scores = [(sum(w in u.lower() for w in of[n, site]) + 0.5 * ("/docs/" in u.lower()), u) for s, u in urls if s == site]
        want += [(n, u, x, i + 1) for i, (x, u) in enumerate(sorted([p for p in scores if p[0] > 0], key=lambda p: (-p[0], p[1]))[:5])]
    key = lambda r: tuple(str(x) for x in r)
    for chunk in (16384, 20):
        made.clear()
        got = [tuple(r) for r in I.keyword_page_match(*frames, **({"chunk": chunk} if chunk < 16384 else {})).collect()]
        assert sorted(set(got), key=key) == sorted(set(want), key=key)
        blocks = 1 if chunk == 16384 else 8
        assert all(n <= 5 * len(asked) * blocks for columns, n in made if "score" in columns)
    assert any("score" in columns for columns, _ in made)


def _exchanged_rows(df):
    """Schemas of the tables that a plan shuffles."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.initialPlan())
        if p.nodeName() == "Exchange":
            found.append(p.schema().simpleString())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_evidence_leaves_most_keywords_at_home(spark, monkeypatch):
    """Keywords go as text, first ones first; repeated rows, nulls and words that only the rest settles give the same as by hand."""
    plans, plain = [], I.settled
    monkeypatch.setattr(I, "settled", lambda df: plans.extend(_exchanged_rows(df)) or plain(df))
    many = [f"word{i}" for i in range(40)]
    asked = [(1, "t", "other", many), (1, "t", "other", many), (2, "t", "other", many[:20] + ["a b", "c-d"]), (3, "t", "other", []), (4, "t", "other", ["word1", "word2"]), (5, "t", "other", ["word1", "word1"])]
    html = {10: "word38 WORD39 error", 11: "word1 xword2x", 12: "a b, c-d", 13: "word39 only", 14: None, 15: ""}
    pairs = [(i, p, 0.5) for i in (1, 2, 3, 4, 5) for p in (10, 11, 12, 13, 14, 15, 16)]
    pages = [(p, h) for p, h in html.items()] + [(11, html[11])]
    got = I.page_evidence(
        spark.createDataFrame(pairs, "issue_id long, page_id long, similarity double"),
        spark.createDataFrame(asked, "issue_id long, title string, category string, keywords array<string>"), spark.createDataFrame(pages, "page_id long, html string"),
    )
    rows = sorted((r.issue_id, r.page_id, r.loaded, r.relevant) for r in got.collect())
    want = []
    for i, _, _, words in asked:
        for j, p, _ in pairs:
            for q, h in [x for x in pages if x[0] == p] or [(p, None)]:
                if i == j:
                    want.append((i, p, p != 16, sum(w in (h or "").lower() for w in words) >= 2))
    assert rows == sorted(want)
    assert not [x for x in plans + _exchanged_rows(got) if "page_id" in x and "plain" in x]
