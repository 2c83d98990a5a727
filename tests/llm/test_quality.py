"""Quality rules, licences and ranking: odd rows, brute force and held-out accuracy."""

import collections
import re
import textwrap
import zlib

import numpy as np
import pandas as pd
import pytest

from doccensus.llm import licences, quality_queries, ranking, rules

SF_DIR = "/root/testdata/sf0.01"


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    mark = [False] * len(words)
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            mark[i] = mark[i + 1] = mark[i + 2] = True
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(mark)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts(spark, odd, clashing):
    texts = ["a b c a b c", "a a a a", "a b a b a b", "x", " x\t\x0by \n", "l\nl\n \n\n l", "á#b é#b á#b é#b", "a b c d a b", "\x1c \x1c \x1c \x1c"]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for docs in (frame, odd, clashing):
        got = rules.judged_columns(rules.judge(docs, ["doc_id", "text"]), "doc_id", "text").collect()
        assert len(got) == docs.count()
        for r in got:
            n = base_counts(r["text"])
            assert tuple(r[c] for c in COUNTS) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r["kept"] and r["base_failed"])


def test_keep_good(clashing, empty):
    kept = rules.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.dtypes == clashing.dtypes
    assert rules.keep_good(empty).count() == 0


def test_distance(spark):
    rows = [([1, 0, 3], [1, 0, 3]), ([1, 0], [0, 1]), ([1, 2, 3], [3, 2, 1]), ([0, 0], [1, 1])]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r[0] for r in frame.select(rules.distance(frame["a"], frame["b"])).collect()]
    p, q = np.array([1, 2, 3]) / 6, np.array([3, 2, 1]) / 6
    m = (p + q) / 2
    assert got[0] == 0 and got[1] == 1 and got[3] is None
    assert got[2] == pytest.approx(np.sqrt((p @ np.log2(p / m) + q @ np.log2(q / m)) / 2))


def dice(a, b):
    def pairs(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:]))

    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licences(spark, odd, clashing, empty):
    longer = licences.TEMPLATES[9][1]
    texts = ["Released under the MIT license", "x\nLicensed under CC BY-NC 4.0!\n" + longer, "Released under the licence of the MIT", None, "", longer.replace(" ", "\n")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["segment"]): (r["licence"], round(r["dice"], 9)) for r in licences.scan(frame).filter("segment >= -1").collect()}
    expected = {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        segments = list(enumerate(t.split("\n"))) + ([(-1, t)] if "\n" in t else [])
        for k, s in segments:
            best = min((-dice(s, x), n) for n, x in licences.TEMPLATES)
            if -best[0] >= 0.8:
                expected[i, k] = (best[1], round(-best[0], 9))
    assert got == expected and len(got) == 5
    assert licences.scan(odd).count() == 0 == licences.scan(empty).count() == licences.scan(clashing).count()


def windows_by_hand(text):
    """Best window of each licence over all positions, those that a better one overlaps left out."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    best = {}
    for name, template in licences.TEMPLATES:
        size = len(re.findall(r"[^\W_]+", template))
        b = set(licences._pairs(template))
        for s in range(len(words)):
            part = words[s : s + size]
            a = {f"{x} {y}" for x, y in zip(part, part[1:])}
            if 2 * len(a & b) >= 0.8 * (len(a) + len(b)) - 1e-9:
                hit = (len(a) + len(b) - 3 * len(a & b), s, name, len(b), len(a & b), len(a), size)
                best[name] = min(best.get(name, hit), hit)
    hits = sorted(best.values())
    return [(h[2], h[1]) for k, h in enumerate(hits) if not any(g[1] < h[1] + h[6] and h[1] < g[1] + g[6] for g in hits[:k])]


def test_notices_inside_texts(spark):
    by_name = {name: text for name, text in licences.TEMPLATES}  # the longest one of each, which comes last
    wrapped = lambda name: "\n".join(textwrap.wrap(by_name[name], 78))
    draw = np.random.default_rng(4)
    prose = lambda n: " ".join(draw.choice("the of house software river under for conditions stone light public".split(), n))
    edited = by_name["BSD-3-Clause"].replace("endorse", "indorse").replace("retain", "keep")
    texts = {
        "MIT": "The MIT License\n\nCopyright (c) 2020 A. N. Other\n\n" + wrapped("MIT"),
        "BSD-3-Clause": prose(40) + "\n" + edited + "\n" + prose(300), "BSD-2-Clause": "Copyright\n" + wrapped("BSD-2-Clause") + "\nTHE SOFTWARE",
        "Zlib": prose(30) + " " + wrapped("Zlib"), "GPL-2.0-or-later": "# " + wrapped("GPL-2.0-or-later").replace("\n", "\n# ") + "\n" + prose(80),
        "GPL-3.0-or-later": "/*\n * " + wrapped("GPL-3.0-or-later").replace("\n", "\n * ") + "\n */ x = 1", "ISC": prose(3) + wrapped("ISC") + prose(500),
    }
    texts["MIT short"] = prose(60) + " Released under the MIT License. " + prose(60)
    texts["none"] = prose(900) + " under the license of the house " + prose(900)
    texts["two"] = texts["Zlib"] + "\n" + prose(100) + "\n" + texts["MIT"]
    names = list(texts)
    frame = spark.createDataFrame([(i, texts[n]) for i, n in enumerate(names)], "doc_id long, text string")
    rows = licences.scan(frame).filter("segment = -2").collect()
    got = {n: sorted((r["licence"], r["start"]) for r in rows if r["doc_id"] == i) for i, n in enumerate(names)}
    assert got == {n: sorted(windows_by_hand(texts[n])) for n in names}
    found = {n: [x for x, _ in got[n]] for n in names}
    assert found.pop("none") == [] and found.pop("two") == ["MIT", "Zlib"] and found.pop("MIT short") == ["MIT"]
    assert all(found[n] == [n] for n in found)


def test_ranking_held_out(spark):
    rows = quality_queries.op4_quality(spark, SF_DIR).toPandas()
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    both = rows.merge(labels, on="doc_id")
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]] == rows["held_out"].tolist()
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert (held["predicted"] == (held["score"] >= 0.5)).all() and rows["score"].between(0, 1).all()


def test_bradley_terry_learns_an_order():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 4))
    label = (x @ [2.0, -1.0, 0.0, 0.5] + draw.normal(size=600) * 0.1 > 0.7).astype(int)
    model = ranking.BradleyTerry(x, label, pairs=5000)
    assert ((model.score(x) >= 0.5) == label).mean() > 0.95
    assert ranking.BradleyTerry(x, np.ones(600)).score(x).tolist() == [0.5] * 600


def test_fit_is_the_minimum_of_the_loss():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 3)) * [1.0, 4.0, 0.2]
    label = (x @ [1.0, -0.2, 3.0] + draw.normal(size=300) > 0).astype(int)
    model = ranking.BradleyTerry(x, label, pairs=1500, ridge=0.01, seed=3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pick = np.random.default_rng(3)
    diff = z[pick.choice(np.flatnonzero(label == 1), 1500)] - z[pick.choice(np.flatnonzero(label == 0), 1500)]
    w = np.zeros(3)
    for _ in range(8000):  # plain gradient descent on mean(log(1 + exp(-diff w))) + ridge / 2 * |w|^2
        w -= 0.5 * (-(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + 0.01 * w)
    assert np.allclose(model.weights, w, atol=1e-4)


def test_repeated_rows_of_a_labelled_document_count_once(spark):
    texts = [(i, ("Good words in a sound line, number %d. " % i) * 3 if i % 2 else "#### !!! %d" % i) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 0)] * 50, "doc_id long, quality int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    more = spark.createDataFrame(texts + [texts[4]] * 500, "doc_id long, text string").repartition(5)
    a, b = ranking.fit(once, labels, 40, 500), ranking.fit(more, labels, 40, 500)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_ranking_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, None), (None, 1), (77, 0), (8, 0)], "doc_id long, quality int")
    model = ranking.fit(clashing, labels)
    assert ranking.score(odd, model).count() == odd.count()
    none = ranking.fit(empty, labels)
    assert {r["score"] for r in ranking.score(odd, none).collect()} == {0.5}
    assert ranking.score(empty, model).count() == 0
