"""Developer issues: classification, matching with pages, gap status.

Substring matches run as equi joins on character grams, similarity as matrix
products inside the cells of an index; nothing compares every issue with every
page row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import by_shuffle, c, contains_any, extract_all, number_rows, rank_within, salted_join, settled, str_array, top_k, trim_ws
from doccensus.operators import vector_index

# ── selection and classification ────────────────────────────────────────


def recent_open(issues: DataFrame, now: Column, days: int = 14, limit: int | None = None) -> DataFrame:
    """Open issues created after the day ``days`` ago, newest first per repository."""
    since = F.date_sub(F.to_date(now), days)
    recent = issues.filter((F.col("state") == "open") & (F.to_date("created_at") > since))
    order = [F.col("created_at").desc(), F.col("number").desc()]
    if limit is None:
        return rank_within(recent, ["repo"], order)
    return top_k(recent, ["repo"], order, limit, ["number"])


def docs_related(title: Column | str, body: Column | str, labels: Column | str) -> Column:
    """Keyword rule: a docs label, a strong signal anywhere, or a medium one."""
    t, b = F.lower(c(title)), F.lower(F.coalesce(c(body), F.lit("")))
    both = F.concat(t, F.lit(" "), b)
    labelled = F.exists(c(labels), lambda x: F.lower(x).isin(K.DOCS_LABELS))
    return labelled | contains_any(t, K.STRONG_DOCS_SIGNALS) | contains_any(b, K.STRONG_DOCS_SIGNALS) | contains_any(both, K.MEDIUM_DOCS_SIGNALS)


def matched_local_signals(title: Column | str, body: Column | str) -> Column:
    both = F.lower(F.concat(c(title), F.lit(" "), F.coalesce(c(body), F.lit(""))))
    return F.filter(str_array(K.LOCAL_DOCS_SIGNALS), lambda s: both.contains(s))


def merge_classification(issues: DataFrame, answers: DataFrame, failed: DataFrame) -> DataFrame:
    """Model answers by number; issues of failed batches fall back to keywords."""
    joined = issues.join(answers.select("number", F.lit(True).alias("_a"), "answer_score", "answer_categories"), "number", "left").join(
        failed.select("number", F.lit(True).alias("_f")), "number", "left"
    )
    fallback = F.col("_f").isNotNull() & docs_related("title", "body", "labels")
    answered = F.col("_a").isNotNull() & F.col("_f").isNull()
    raw = F.when(F.coalesce("answer_score", F.lit(0)) == 0, F.lit(75)).otherwise(F.col("answer_score"))
    score = F.when(answered, F.least(F.lit(100), F.greatest(F.lit(0), raw))).when(fallback, 50).otherwise(0)
    tag = str_array(["docs-related"])
    empty = F.array().cast("array<string>")
    return joined.select(
        "number", (answered | fallback).alias("docs_related"), score.cast("long").alias("docs_confidence"),
        F.when(answered, F.coalesce("answer_categories", tag)).when(fallback, tag).otherwise(empty).alias("docs_categories"),
    )


def make_batches(issues: DataFrame, size: int = 50, body_chars: int = 400) -> DataFrame:
    """Numbered groups of at most ``size`` issues with their request payload."""
    rows = number_rows(issues, "number", "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size))
    item = F.struct("number", "title", "labels", F.substring(F.coalesce("body", F.lit("")), 1, body_chars).alias("body"))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("batch", F.size("items").cast("long").alias("n"), "items", F.to_json("items").alias("payload"))


def categorize(text: Column | str) -> Column:
    low = F.lower(c(text))
    out = None
    for name, words in K.ISSUE_CATEGORIES:
        out = F.when(contains_any(low, words), name) if out is None else out.when(contains_any(low, words), name)
    return out.otherwise("general")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(trim_ws(F.substring(text, 1, n)), F.lit("...")))


def from_question_stats(questions: DataFrame) -> DataFrame:
    """Issue rows from question titles, view counts and scores."""
    views = F.coalesce("view_count", F.lit(0))
    score = F.coalesce("score", F.lit(0))
    return questions.select(
        F.concat(F.lit("stackoverflow-"), "question_id").alias("id"), truncate(F.col("title"), 80).alias("title"),
        categorize("title").alias("category"), truncate(F.col("title"), 120).alias("description"),
        F.least(F.floor(views / 100), F.lit(50)).cast("long").alias("frequency"),
        F.when(score > 5, "high").when(score > 2, "medium").otherwise("low").alias("severity"),
    )


def rank_issues(issues: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent, then most recent issues of every company."""
    order = [F.col("frequency").desc(), F.col("last_seen").desc(), F.col("id")]
    return top_k(issues, ["company"], order, limit, ["id"])


def add_audits(issues: DataFrame, companies: DataFrame, today: Column, fewer_than: int = 4) -> DataFrame:
    """Append standard audit rows to companies with few issues of their own."""
    counts = issues.groupBy("company").agg(F.count("*").alias("n"))
    low = F.lower("domain")
    kind = None
    for part, name in K.PRODUCT_CATEGORIES:
        kind = F.when(low.contains(part), name) if kind is None else kind.when(low.contains(part), name)
    rows = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(cat).alias("category"),
                 F.lit(freq).cast("long").alias("frequency"), F.lit(sev).alias("severity"))
        for k, i, t, cat, freq, sev in K.PROACTIVE_AUDITS
    ])
    short = companies.join(counts, "company", "left").filter(F.coalesce("n", F.lit(0)) < fewer_than).withColumn("_kind", kind)
    audits = short.select("company", "_kind", F.explode(rows).alias("a")).filter(F.col("a.kind") == F.col("_kind"))
    extra = audits.select("company", "a.id", "a.title", "a.category", "a.frequency", "a.severity", today.alias("last_seen"))
    columns = ["company", "id", "title", "category", "frequency", "severity", "last_seen"]
    return issues.select(*columns).unionByName(extra)


# ── keywords and page matches ───────────────────────────────────────────


def issue_keywords(text: Column | str, category: Column | str) -> Column:
    """Distinct words of 3+ letters or digits minus stop words, plus the category's words."""
    runs = extract_all(F.lower(c(text)), "[a-z0-9_]+", 0)
    words = F.filter(runs, lambda w: w.rlike("^[a-z0-9]{3,}$"))
    pairs = [x for k, v in K.CATEGORY_KEYWORDS.items() for x in (F.lit(k), str_array(v))]
    extra = F.coalesce(F.try_element_at(F.create_map(*pairs), c(category)), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array_except(F.array_distinct(words), str_array(K.STOP_WORDS)), extra))


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; a shorter text has none."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>")))


def contained_words(words: DataFrame, texts: DataFrame, site: str, word: str, text: str, gram: int = 3) -> DataFrame:
    """Pairs (site, word, text) where the text contains the word, for words of ``gram`` characters or more.

    An inverted index on character grams: texts are posted by number under each of their grams, and a word looks only under
    the one that the fewest texts of its site have, followed by an exact check. Words that have a gram no text has are gone
    before; most go by their first gram alone, so what is cut into grams on the word side is little more than what can match.
    """
    # numbers given here stay as written
    numbered = settled(texts.select(site, text).distinct().withColumn("_t", F.monotonically_increasing_id()))
    posted = numbered.select(site, "_t", F.explode(_grams(F.col(text), gram)).alias("_g"))
    spread = settled(posted.groupBy(site, "_g").agg(F.count("*").alias("_df")))
    # written, as the planner takes the semi join below the distinct, and so every word of every text through a shuffle
    distinct = settled(words.select(site, word).distinct()).withColumn("_g", F.substring(word, 1, gram))
    starts = distinct.join(by_shuffle(spread.select(site, "_g")), [site, "_g"], "left_semi").drop("_g")
    parts = starts.withColumn("_all", _grams(F.col(word), gram)).withColumn("_n", F.size("_all")).withColumn("_g", F.explode("_all")).drop("_all")
    rarest = parts.join(by_shuffle(spread), [site, "_g"]).groupBy(site, word).agg(
        F.min_by("_g", F.struct("_df", "_g")).alias("_g"), F.count("*").alias("_found"), F.max("_n").alias("_n")
    ).filter("_found = _n").select(site, word, "_g")
    met = by_shuffle(posted).join(rarest, [site, "_g"]).select("_t", word)
    return met.join(by_shuffle(numbered), "_t").filter(F.col(text).contains(F.col(word))).select(site, word, text)


def _matched_classes(hits: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """class_id, site, held, bonus, first_urls: URLs of a site that hold the same words and bonus, with the first ``k`` of them."""
    held = hits.groupBy("site", "lu").agg(F.array_sort(F.collect_set("word")).alias("held"))
    bonus = F.when(F.col("lu").contains("/docs/"), 0.5).otherwise(0.0)
    placed = low.join(by_shuffle(held), ["site", "lu"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<bigint>"))).withColumn("bonus", bonus)
    firsts = top_k(placed, ["site", "held", "bonus"], [F.col("url")], k, ["url"], rank="_r").groupBy("site", "held", "bonus").agg(
        F.array_sort(F.collect_list("url")).alias("first_urls")
    )
    return firsts.withColumn("class_id", F.monotonically_increasing_id())


def _asked_words(asking: DataFrame, known: DataFrame, chunk: int) -> DataFrame:
    """issue_id, site, words: the sorted numbers of an issue's known words.

    Few keywords stand in any URL, so they do not go to the known words one by one: issues are cut into blocks of at most about
    ``chunk``, keywords go there as one string, and each block gets the known words of its site.
    """
    number, blocks = asking.schema["issue_id"].dataType.simpleString(), -(-asking.count() // chunk)
    joined = F.array_join(F.filter("keywords", lambda w: ~w.contains(" ")), " ").alias("plain")
    texts = asking.filter("issue_id IS NOT NULL").select("issue_id", "site", joined, F.filter("keywords", lambda w: w.contains(" ")).alias("other"))
    left = texts.withColumn("q", F.pmod(F.xxhash64("issue_id"), F.lit(max(1, blocks))).cast("int"))
    right = known.select("site", "kw", "word").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))

    def numbered(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        of, found = dict(zip(known["kw"], known["word"], strict=True)), {}
        for issue, plain, other in zip(texts["issue_id"], texts["plain"], texts["other"], strict=True):
            words = (plain or "").split(" ") + list([] if other is None else other)
            found.setdefault(issue, set()).update(of[w] for w in words if w in of)
        words = {issue: sorted(held) for issue, held in found.items()}
        return pd.DataFrame({"issue_id": texts["issue_id"], "site": texts["site"], "words": [words[i] for i in texts["issue_id"]]})

    made = left.groupBy("site", "q").cogroup(right.groupBy("site", "q")).applyInPandas(numbered, f"issue_id {number}, site string, words array<long>")
    unnamed = asking.filter("issue_id IS NULL").select("issue_id", "site", F.array().cast("array<long>").alias("words"))
    return made.unionByName(unnamed)


def _best_classes(asked: pd.DataFrame, held: pd.DataFrame, k: int, crowd: int = 16) -> pd.DataFrame:
    """set_id, class_id, score: for each set of a block the first ``k`` classes by score, then by their first URL.

    No other class of the block has one of its first ``k`` URLs. Words of a ``crowd``-th of the classes or more are rows of a
    matrix, others lists of classes; scores are doubled, to be integers.
    """
    out = {"set_id": [], "class_id": [], "score": []}
    if len(asked) and len(held):
        first = held["first_url"].tolist()
        held = held.iloc[sorted(range(len(held)), key=first.__getitem__)]
        n, flat = len(held), lambda df, col: np.concatenate(df[col].to_numpy()).astype(np.int64)
        words, at = flat(held, "held"), np.repeat(np.arange(n), held["held"].str.len())
        order = np.argsort(words, kind="stable")
        names, begin = np.unique(words[order], return_index=True)
        lists = np.split(at[order], begin[1:])
        common = {}
        for j in np.flatnonzero(np.diff(np.append(begin, len(words))) * crowd >= n):
            common[j] = np.zeros(n, dtype=np.int32)
            common[j][lists[j]] = 2
        bonus, ids = (held["bonus"].to_numpy() * 2).astype(np.int32), held["class_id"].to_numpy()
        for set_id, ws in zip(asked["set_id"], asked["words"], strict=True):
            score, rare = bonus.copy(), []
            ws = np.asarray(ws, dtype=np.int64)
            for j in np.searchsorted(names, ws[np.isin(ws, names, assume_unique=True)]):
                if j in common:
                    score += common[j]
                else:
                    rare.append(lists[j])
            if rare:
                hit, times = np.unique(np.concatenate(rare), return_counts=True)
                score[hit] += 2 * times.astype(np.int32)
            reach = np.cumsum(np.bincount(score)[::-1])
            least = max(1, len(reach) - 1 - int(np.searchsorted(reach, k)))
            best = np.flatnonzero(score > least)
            best = np.concatenate([best, np.flatnonzero(score == least)[: k - len(best)]])
            out["set_id"].append(np.full(len(best), set_id))
            out["class_id"].append(ids[best])
            out["score"].append(score[best] / 2)
    whole = {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}
    return pd.DataFrame(whole).astype({"set_id": "int64", "class_id": "int64", "score": "float64"})


def keyword_page_match(issues: DataFrame, urls: DataFrame, k: int = 5, chunk: int = 16384) -> DataFrame:
    """Best ``k`` URLs of its site for every issue: +1 per keyword in the URL, +0.5 under /docs/.

    ``issues`` (issue_id, site, keywords), ``urls`` (site, url). ``issues`` is read several times: what makes it of whole texts
    is best written before. Exact, without a row for an issue and a URL beyond the best:

    * words meet URLs in an inverted index on their rarest gram (``contained_words``);
    * URLs with the same words and bonus form a class, of which the first ``k`` matter; issues with the same matched words
      form a set, which is answered once;
    * the sets of a site are cut into blocks of about ``chunk``, its classes into blocks of twice as many. A pair of blocks is
      scored in one task and gives ``k`` classes for each set; the best of all blocks are ranked.

    URLs without a keyword count by their bonus alone.
    """
    low = settled(urls.select("site", "url", F.lower("url").alias("lu")).distinct())
    asking = issues.select("issue_id", "site", "keywords")
    hits = settled(contained_words(asking.select("site", F.explode("keywords").alias("kw")), low, "site", "kw", "lu"))
    # numbers given here stay as written
    known = settled(hits.select("site", "kw").distinct().withColumn("word", F.monotonically_increasing_id()))
    classes = settled(_matched_classes(hits.join(by_shuffle(known), ["site", "kw"]).select("site", "lu", "word"), low, k))
    asked = settled(_asked_words(asking, known, chunk))
    sets = settled(asked.select("site", "words").distinct().withColumn("set_id", F.monotonically_increasing_id()))

    blocks = lambda df, size, name: df.groupBy("site").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = by_shuffle(settled(blocks(sets, chunk, "a").join(by_shuffle(blocks(classes, 2 * chunk, "b")), "site")))
    place, copies = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = salted_join(sets, sizes, ["site"], ["set_id"]).select("site", "set_id", "words", place("set_id", F.col("a")).alias("qa"), copies("b").alias("pb"))
    right = salted_join(classes, sizes, ["site"], ["class_id"]).select(
        "site", "class_id", "held", "bonus", F.col("first_urls")[0].alias("first_url"), place("class_id", F.col("b")).alias("pb"), copies("a").alias("qa")
    )
    by = ["site", "qa", "pb"]
    score = lambda q, p: _best_classes(q, p, k)
    scored = settled(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(score, "set_id long, class_id long, score double"))
    best = top_k(
        scored.join(by_shuffle(classes.select("class_id", "first_urls")), "class_id").select("set_id", "score", F.explode("first_urls").alias("url")),
        ["set_id"], [F.col("score").desc(), F.col("url")], k, ["url"],
    )
    return asked.join(by_shuffle(sets), ["site", "words"]).select("issue_id", "set_id").join(by_shuffle(best), "set_id").select("issue_id", "url", "score", "rank")


def keyword_entry_match(issues: DataFrame, entries: DataFrame, k: int = 15, body_chars: int | None = None) -> DataFrame:
    """Best ``k`` entries of a site by how many words of its issues they contain.

    Words longer than three characters of all issues of the site form one set,
    so an entry is matched once, however many issues there are.
    """
    body = F.coalesce("body", F.lit(""))
    text = F.lower(F.concat("title", F.lit(" "), body if body_chars is None else F.substring(body, 1, body_chars)))
    words = issues.select("site", F.explode(F.filter(F.split(text, "[^a-z0-9_]+"), lambda w: F.length(w) > 3)).alias("kw"))
    texts = entries.withColumn("text", F.lower(F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")))))
    hits = contained_words(words, texts, "site", "kw", "text")
    counts = hits.groupBy("site", "text").agg(F.count("*").alias("matches"))
    order = [F.col("matches").desc(), F.col("url"), F.col("text")]
    return top_k(texts.join(counts, ["site", "text"]), ["site"], order, k, ["url", "text"]).drop("text")


def relevant_docs(issues: DataFrame, docs: DataFrame, at_least: int = 4, chunk: int = 4096) -> DataFrame:
    """Documents of the same repository that contain more than three issue words.

    Words are whitespace tokens longer than four characters, counted with repeats. A token inside a document lies inside one
    of its tokens, so the substring test runs between the two vocabularies, on grams of five characters. What follows
    counts common words, and as most pairs of a repository have some, its issues and documents are cut into blocks of about
    ``chunk`` documents and a quarter as many issues; each pair of blocks is a matrix product, so neither a common word nor a
    large repository meets one task. Issues whose found words cannot add up to the threshold are left out before.
    """
    low = F.lower(F.concat("title", F.lit(" "), F.coalesce("body", F.lit(""))))
    issue_words = settled(issues.select("number", "repo", F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 4).alias("words")))
    words = issue_words.select("number", "repo", F.explode("words").alias("word")).groupBy("number", "repo", "word").agg(F.count("*").alias("m"))
    tokens = settled(
        docs.select("repo", "doc_id", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("token")).filter(F.length("token") > 4)
    )
    known = contained_words(words, tokens, "repo", "word", "token", gram=5)
    in_docs = settled(tokens.join(by_shuffle(known), ["repo", "token"]).select("repo", "doc_id", "word").distinct())
    # numbers given here stay as written
    numbers = settled(in_docs.select("repo", "word").distinct().withColumn("w", F.monotonically_increasing_id()))
    postings = settled(in_docs.join(by_shuffle(numbers), ["repo", "word"]).groupBy("repo", "doc_id").agg(F.collect_list("w").alias("ws")))
    found = words.join(by_shuffle(numbers), ["repo", "word"]).groupBy("repo", "number").agg(F.collect_list(F.struct("w", "m")).alias("found"), F.sum("m").alias("all"))
    asked = settled(found.filter(F.col("all") >= at_least).select("repo", "number", F.col("found.w").alias("ws"), F.col("found.m").alias("ms")))

    blocks = lambda df, size, name: df.groupBy("repo").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = settled(blocks(asked, max(1, chunk // 4), "a").join(blocks(postings, chunk, "b"), "repo"))
    place, copies = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = salted_join(asked, sizes, ["repo"], ["number"]).select("repo", "number", "ws", "ms", place("number", F.col("a")).alias("qa"), copies("b").alias("pb"))
    right = salted_join(postings, sizes, ["repo"], ["doc_id"]).select("repo", "doc_id", "ws", place("doc_id", F.col("b")).alias("pb"), copies("a").alias("qa"))
    by = ["repo", "qa", "pb"]
    count = lambda q, p: _common_words(q, p, at_least)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(count, "number long, doc_id long, matches long")


def _common_words(asked: pd.DataFrame, held: pd.DataFrame, at_least: int, width: int = 2048, few: int = 8192) -> pd.DataFrame:
    """number, doc_id, matches of two blocks: words that make ``few`` pairs or less by a join, others as columns of a product."""
    if not len(asked) or not len(held):
        return pd.DataFrame({"number": [], "doc_id": [], "matches": []}).astype("int64")
    flat = lambda df, col: np.concatenate(df[col].to_numpy())
    at = lambda df: np.repeat(np.arange(len(df)), df["ws"].str.len())
    q = pd.DataFrame({"w": flat(asked, "ws"), "q": at(asked), "m": flat(asked, "ms")})
    p = pd.DataFrame({"w": flat(held, "ws"), "p": at(held)})
    pairs = (q["w"].value_counts() * p["w"].value_counts()).dropna()
    total = np.zeros((len(asked), len(held)), dtype=np.float64)
    rare = pairs.index[pairs <= few]
    met = q[q["w"].isin(rare)].merge(p, on="w")
    np.add.at(total, (met["q"].to_numpy(), met["p"].to_numpy()), met["m"].to_numpy())
    common = np.sort(pairs.index[pairs > few].to_numpy())
    for start in range(0, len(common), width):
        part = common[start : start + width]
        x, y = q[q["w"].isin(part)], p[p["w"].isin(part)]
        a, b = np.zeros((len(asked), len(part)), dtype=np.float32), np.zeros((len(part), len(held)), dtype=np.float32)
        a[x["q"].to_numpy(), np.searchsorted(part, x["w"])] = x["m"].to_numpy()
        b[np.searchsorted(part, y["w"]), y["p"].to_numpy()] = 1
        total += a @ b
    i, j = np.nonzero(total >= at_least)
    return pd.DataFrame({"number": asked["number"].to_numpy()[i], "doc_id": held["doc_id"].to_numpy()[j], "matches": total[i, j].astype(np.int64)})


def local_ranking(issues: DataFrame, relevant: DataFrame) -> DataFrame:
    """Docs-related issues first, then by reactions."""
    docs = relevant.groupBy("number").agg(F.count("*").alias("n"))
    labelled = F.exists("labels", lambda x: F.lower(x).isin(K.LOCAL_DOCS_LABELS))
    signals = F.size(matched_local_signals("title", "body")) > 0
    related = signals | labelled | F.col("n").isNotNull()
    return issues.join(docs, "number", "left").select(
        "number", related.alias("likely_docs"), F.coalesce("n", F.lit(0).cast("long")).alias("relevant_docs"), "reactions"
    ).orderBy(F.col("likely_docs").desc(), F.col("reactions").desc(), "number")


def similar_pages(issue_vecs: DataFrame, page_vecs: DataFrame, k: int = 5, block: int = 8192, cells: int | None = None) -> DataFrame:
    """Exact cosine top ``k`` pages for every issue vector, by an inverted file (``vector_index``).

    A zero vector has similarity 0; vectors of unequal length are an error.
    """
    return vector_index.search(issue_vecs, vector_index.build_index(page_vecs, cells), k, block)


# ── evidence and status ─────────────────────────────────────────────────


def page_evidence(pairs: DataFrame, issues: DataFrame, pages: DataFrame, first: int = 16) -> DataFrame:
    """What each candidate page offers an issue and what it lacks.

    ``pairs`` (issue_id, page_id, similarity), ``issues`` (issue_id, title,
    category, keywords), ``pages`` (page_id, html); equi joins. The ``first``
    keywords of an issue go to its candidates, all of them only where those do
    not settle it. A candidate whose page did not load keeps a row with
    ``loaded`` false.
    """
    from doccensus.functions import html as H

    low = F.lower("html")
    has = lambda *words: contains_any(low, words)
    # what only depends on the page is found once per page, before pairs meet it; a word of letters and digits lies inside
    # a run of them, so it is looked up in the distinct runs, a fraction of the page. Numbers given here stay as written
    runs = F.array_distinct(F.filter(extract_all(low, "[a-z0-9]+", 0), lambda r: F.length(r) >= 3))
    facts = settled(pages.select(
        "page_id", low.alias("low"), F.array_join(runs, " ").alias("runs"),
        F.regexp_count("html", F.lit("(?i)<code|<pre|```")).cast("long").alias("code_examples"),
        contains_any(low, K.PRODUCTION_WORDS).alias("production_guidance"), has("error", "troubleshoot").alias("has_errors"),
        has("spam", "deliverability").alias("has_spam"), has("dns", "spf", "dkim").alias("has_dns"), has("vercel", "netlify").alias("has_platform"),
        has("environment variable", "env").alias("has_env"), H.title("html").alias("page_title"), F.lit(True).alias("loaded"),
        F.monotonically_increasing_id().alias("_p"),
    ))
    simple = lambda w: w.rlike("^[a-z0-9]{3,}$")
    asked = settled(issues.select(
        "issue_id", "title", "category", F.array_join(F.filter("keywords", simple), " ").alias("plain"), F.filter("keywords", lambda w: ~simple(w)).alias("other"),
        F.monotonically_increasing_id().alias("_i"),
    ))
    named = asked.select("issue_id", "title", "category", F.substring_index("plain", " ", first).alias("first"), "_i")
    j = by_shuffle(pairs).join(named, "issue_id").join(by_shuffle(facts.drop("low")), "page_id", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))
    deploy, mail = F.col("category") == "deployment", F.col("category") == "email-delivery"
    gaps = [
        (F.col("code_examples") == 0, "code-examples"),
        (deploy & ~F.col("production_guidance"), "production-guidance"),
        (~F.col("has_errors"), "error-handling"),
        (mail & ~F.col("has_spam"), "spam-handling"),
        (mail & ~F.col("has_dns"), "dns-setup"),
        (deploy & ~F.col("has_platform") & F.lower("title").contains("vercel"), "platform-deployment"),
        (deploy & ~F.col("has_env"), "environment-setup"),
    ]
    held = lambda words, text: F.size(F.filter(words, lambda w: (w != "") & F.col(text).contains(w)))
    listed = lambda words: F.split(words, " ")
    met = settled(j.select(
        "issue_id", "page_id", "similarity", "loaded", "code_examples", "production_guidance", "page_title",
        F.filter(F.array(*[F.when(cond, text) for cond, text in gaps]), lambda g: g.isNotNull()).alias("gaps"),
        "_i", "_p", F.coalesce(F.col("loaded") & (held(listed("first"), "runs") >= 2), F.lit(False)).alias("_soon"),
    ))
    # a page that holds two of the first words is not searched for the others, and those do not go to it
    open_ = met.filter("loaded AND NOT _soon").select("_i", "_p").distinct()
    whole = open_.join(by_shuffle(asked.select("_i", "plain", "other")), "_i").join(by_shuffle(facts.select("_p", "low", "runs")), "_p")
    late = whole.select("_i", "_p", (held(listed("plain"), "runs") + held("other", "low") >= 2).alias("_late"))
    relevant = F.when(F.col("loaded"), F.when(F.col("_soon"), True).otherwise(F.col("_late"))).otherwise(False)
    return met.join(by_shuffle(late), ["_i", "_p"], "left").select(
        "issue_id", "page_id", "similarity", "loaded", relevant.alias("relevant"), "code_examples", "production_guidance", "page_title", "gaps",
    )


def issue_status(issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """Documentation-gap status and confidence of every issue.

    An issue without candidate pages is a critical gap (95); one whose pages
    all failed to load is a critical gap (85).
    """
    sim = F.when(F.col("loaded"), F.coalesce("similarity", F.lit(0.0))).otherwise(0.0)
    facts = evidence.groupBy("issue_id").agg(
        F.lit(True).alias("_had"), F.bool_or(F.col("relevant") & (F.size("gaps") == 0) & (sim > 0.85)).alias("complete"),
        F.bool_or(sim > 0.6).alias("near"), F.bool_or("relevant").alias("any_relevant"),
    )
    j = issues.select("issue_id").join(by_shuffle(facts), "issue_id", "left")
    flag = lambda x: F.coalesce(x, F.lit(False))
    rule = (
        F.when(F.col("_had").isNull(), F.struct(F.lit("critical-gap").alias("s"), F.lit(95).alias("n")))
        .when(flag("complete"), F.struct(F.lit("resolved").alias("s"), F.lit(90).alias("n")))
        .when(flag("near"), F.struct(F.lit("potential-gap").alias("s"), F.lit(75).alias("n")))
        .when(flag("any_relevant"), F.struct(F.lit("confirmed").alias("s"), F.lit(70).alias("n")))
        .otherwise(F.struct(F.lit("critical-gap").alias("s"), F.lit(85).alias("n")))
    )
    return j.select("issue_id", rule["s"].alias("status"), rule["n"].cast("long").alias("confidence"))


def best_match(evidence: DataFrame) -> DataFrame:
    """Most similar page per issue, lowest page id on ties; weak ones get generic advice."""
    sim = F.coalesce("similarity", F.lit(0.0))
    best = evidence.filter("loaded").groupBy("issue_id").agg(F.min_by(F.struct("page_id", sim.alias("sim")), F.struct(-sim, F.col("page_id"))).alias("b"))
    return best.select(
        "issue_id", F.col("b.page_id").alias("page_id"), F.col("b.sim").alias("similarity"),
        F.when(F.col("b.sim") < 0.5, "generic").otherwise("detailed").alias("advice"),
    )


def status_summary(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(
        F.count("*").alias("total"), n("confirmed").alias("confirmed"), n("resolved").alias("resolved"),
        n("potential-gap").alias("potential_gaps"), n("critical-gap").alias("critical_gaps"),
    )


def rank_gaps(results: DataFrame, per_session: int | None = None) -> DataFrame:
    """Issues of each session, most confident first; with ``per_session`` the first in request order only."""
    ranked = [F.col("confidence").desc(), F.col("pos")]
    if per_session is None:
        return rank_within(results, ["session_id"], ranked)
    kept = top_k(results, ["session_id"], [F.col("pos")], per_session, ["pos"], rank="_r").drop("_r")
    return top_k(kept, ["session_id"], [F.col("confidence").desc(), F.col("pos")], per_session, ["pos"])


def docs_repo_candidates(repos: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Likely documentation repositories of every owner, newest first, with content counts."""
    topic = F.exists("topics", lambda t: t.rlike(K.DOCS_REPO_TOPIC_PATTERN))
    likely = F.col("name").rlike(K.DOCS_REPO_NAME_PATTERN) | F.coalesce("description", F.lit("")).rlike(K.DOCS_REPO_DESC_PATTERN) | topic
    order, likely_repos = [F.col("updated_at").desc(), F.col("name")], repos.filter(likely & ~F.col("is_current"))
    if limit is None:
        chosen = rank_within(likely_repos, ["owner"], order)
    else:
        chosen = top_k(likely_repos, ["owner"], order, limit, ["name"])
    low = F.lower("path")
    is_file, folder = F.col("type") == "file", F.regexp_extract(low, "^([^/]+)/[^/]+$", 1)
    root = ~F.col("path").contains("/")
    md = is_file & low.rlike(r"\.mdx?$")
    counts = files.groupBy("owner", F.col("repo").alias("name")).agg(
        F.bool_or(is_file & root & (low == "llms.txt")).alias("has_llms_txt"),
        F.count_if(is_file & root & low.rlike(K.CODE_FILE_PATTERN)).alias("code_files"),
        F.count_if((md & root & ~low.isin(K.BOILERPLATE_FILES)) | (md & folder.isin(K.CONTENT_FOLDERS))).alias("md_files"),
    )
    flag = F.coalesce("has_llms_txt", F.lit(False))
    n = F.coalesce("md_files", F.lit(0).cast("long"))
    return chosen.join(counts, ["owner", "name"], "left").select(
        "owner", "name", F.col("rank").cast("long").alias("rank"), flag.alias("has_llms_txt"), (flag | (n >= 5)).alias("has_docs_content"),
        F.when(flag, F.lit(-1).cast("long")).otherwise(n).alias("content_files"), F.coalesce("code_files", F.lit(0).cast("long")).alias("code_files"),
    )


def enrich(issues: DataFrame, posts: DataFrame, content_chars: int | None = None, bodies: int | None = 3) -> DataFrame:
    """Add what the first source page of an issue says, its first ``bodies`` posts (None: all); unmatched issues stay as they are."""
    from doccensus.functions import html as H

    whole = trim_ws(F.regexp_replace(F.regexp_replace(F.array_join(H.post_bodies("html", bodies), ""), "<[^>]+>", " "), r"\s+", " "))
    facts = posts.select(
        F.col("url").alias("source_url"),
        (whole if content_chars is None else F.substring(whole, 1, content_chars)).alias("full_content"),
        H.post_code_snippets("html").alias("code_snippets"), H.error_messages("html").alias("error_messages"),
        H.post_tags("html").alias("tags"), H.stack_trace("html").alias("stack_trace"),
    )
    return issues.withColumn("source_url", F.get("sources", F.lit(0))).join(facts, "source_url", "left")


def select_docs_pages(pages: DataFrame, picked: DataFrame, failed_sites: DataFrame, fallback: DataFrame, more_than: int = 10, content_chars: int | None = None) -> DataFrame:
    """Pages an issue review reads: the picked ones on large sites, else all.

    ``picked`` (site, url) are model choices, ``fallback`` (site, url) the
    keyword matches used where the model failed; a large site left with no
    choice keeps every page.
    """
    usable = pages.filter(F.length("content") > 100).select("site", "url", (F.col("content") if content_chars is None else F.substring("content", 1, content_chars)).alias("content"))
    size = usable.groupBy("site").agg(F.count("*").alias("n"))
    good = picked.join(failed_sites.select("site"), "site", "left_anti").unionByName(fallback.join(failed_sites.select("site"), "site", "left_semi"))
    good = good.select("site", "url").distinct().withColumn("_pick", F.lit(True))
    valid = usable.select("site", "url").join(good, ["site", "url"], "left_semi").select("site").distinct().withColumn("_any", F.lit(True))
    j = salted_join(usable.join(good, ["site", "url"], "left"), size.join(valid, "site", "left"), ["site"], ["url"])
    narrow = (F.col("n") > more_than) & F.col("_any").isNotNull()
    return j.filter(~narrow | F.col("_pick").isNotNull()).select("site", "url", "content")


def page_embedding_text(title: Column, description: Column, content: Column) -> Column:
    """Text to embed for a page; null when under ten characters."""
    text = trim_ws(F.concat_ws(" ", title, description, content))
    return F.when(F.length(text) >= 10, text)


def issue_embedding_text(df: DataFrame) -> Column:
    part = lambda col: F.nullif(F.coalesce(F.col(col), F.lit("")), F.lit(""))
    joined = lambda col: F.when(F.size(col) > 0, F.array_join(col, " "))
    return F.concat_ws(
        " ", "title", "description", "category", part("full_content"), joined("code_snippets"), joined("error_messages"), joined("tags"), part("stack_trace")
    )
