"""Duplicates, repeats and leaks against brute force."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doccensus.llm import decontamination, graph, near_duplicates, passages, repeats
from doccensus.llm.shared import normal_words, written
from doccensus.llm.suffix_groups import suffix_array


def prose(draw, n):
    return " ".join(draw.choice("abcdefghijklmnop") + str(draw.randrange(400)) for _ in range(n))


def edited(draw, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    x = [*symbols, 0]
    assert suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 12))
def test_banded_alignment(a, b, limit):
    expected = min(edit_distance(a, b), limit + 1)
    assert near_duplicates.edit_distance_within(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), limit) == expected


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)]
    edges = [*chain, *star, *loose, (5, 5), (0, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components_of(real, {x for e in real for x in e})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes(frame):
    return {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(frame).collect()}


def test_near_duplicates(spark):
    draw = random.Random(1)
    base = [prose(draw, n) for n in (8, 30, 120, 200, 200, 300)]
    texts = [*base, *[edited(draw, draw.choice(base[2:]), draw.randrange(0, 4)) for _ in range(80)], base[2].upper(), base[3] + "!", prose(draw, 60)]
    # half of one text, and one text in another order: no near duplicates
    halves = base[4].split(" ")
    texts += [" ".join(halves[:100]), " ".join(halves[100:] + halves[:100])]
    words = [normal_words(t) for t in texts]
    links = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if 1 - edit_distance(words[i], words[j]) / max(len(words[i]), len(words[j])) >= near_duplicates.SIMILARITY
    ] if len(texts) < 30 else None
    near = [(i, j) for i in range(len(texts)) for j in range(i) if _similar(words[i], words[j])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert links is None or links == near
    assert classes(frame) == components_of(near, range(len(texts)))


def _similar(a, b):
    limit = int((1 - near_duplicates.SIMILARITY) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if len(set(a) & set(b)) < 0.5 * min(len(set(a)), len(set(b))):
        return False  # fewer common words than the similarity leaves room for
    return edit_distance(a, b) <= limit


def test_links_between_components_of_one_key(spark):
    """All nodes share one key; the least node is like none of the others."""
    frame = spark.createDataFrame([(n, 10, 1) for n in range(8)], "node long, size int, key long")
    true = spark.createDataFrame([(2, 5), (5, 7), (3, 4)], "a long, b long")
    asked = []

    def verify(pairs):
        asked.extend(tuple(r) for r in pairs.collect())
        return pairs.join(true, ["a", "b"], "left_semi")

    found = {tuple(r) for r in graph.links(graph.colliding(frame), verify, 0.8).collect()}
    assert found == {(2, 5), (5, 7), (3, 4)}
    assert len(asked) == len(set(asked))


def test_near_duplicates_of_small_vocabularies(spark):
    # logs, tables and lists: few words, and a copy with a list of new words appended or put in; runs have an index of 0.83
    draw, texts = random.Random(11), []
    for k in range(60):
        n, vocabulary = ((1000, 100), (5000, 400))[k % 2]
        body = [f"w{k}x{draw.randrange(vocabulary)}" for _ in range(n)]
        at = draw.choice((n, n // 3))
        texts += [" ".join(body), " ".join([*body[:at], *(f"new{k}n{i}" for i in range(n // 5)), *body[at:]])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert classes(frame) == {i: i - i % 2 for i in range(len(texts))}


def test_first_units_of_similar_texts():
    draw, rng = random.Random(12), np.random.default_rng(12)
    seen = 0
    for _ in range(600):
        a = [draw.randrange(draw.choice((3, 30, 1000))) for _ in range(draw.randrange(1, 60))]
        b = list(a)
        for _ in range(draw.randrange(0, 1 + (len(a) + 4) // 4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = [draw.randrange(2000)] * draw.randrange(2)
        for similarity in (0.5, 0.8, 0.9):
            if a and b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= similarity - 1e-9:
                often = rng.integers(0, 3, 1 << near_duplicates.COUNT_BITS).astype(np.uint8)
                for n in (1, 2):
                    x, y = (near_duplicates.first_units(np.array(w, dtype="<u4"), often, similarity, n) for w in (a, b))
                    assert set(x.tolist()) & set(y.tolist())
                seen += a != b
    assert seen > 300


def test_common_passage_pairs_no_unlike_texts(spark):
    # 150 texts of which 100 words are one passage, and two more that are similar only to each other
    draw = random.Random(13)
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join([f"own{k}n{draw.randrange(10**6)}" for _ in range(60)] + passage) for k in range(150)]
    texts += [" ".join([f"pair{i}" for i in range(60)] + passage), " ".join(passage + [f"pair{i}" for i in range(60)])]
    texts.append(" ".join([f"pair{i}" for i in range(58)] + passage))
    made = near_duplicates.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = made.select(F.col("doc_id").alias("node"), F.col("n_words").alias("size"), F.explode("keys").alias("key"))
    tried = []

    def verify(pairs):
        tried.append(pairs.count())
        return near_duplicates._verified(pairs, made, 0.8)

    found = graph.links(graph.colliding(rows), verify, 0.8, splits=near_duplicates._splits(made, 0.8))
    assert {tuple(r) for r in found.collect()} == {(150, 152)}
    assert tried[-1] < 300


def test_near_duplicates_odd_rows(spark, odd, clashing, empty):
    got = classes(odd)
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, None: None, 6: 1, 7: 7, 8: 8, 9: 9}
    kept = near_duplicates.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert near_duplicates.near_duplicates(empty).count() == 0 == near_duplicates.keep_one(empty).count()


def cut_by_hand(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[a : a + length] for r in raws for a in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [128, 3])
def test_repeats(spark, group):
    draw = random.Random(group)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(1, 6))) for _ in range(30)]
    base = [" ".join(draw.choice(words) for _ in range(draw.randrange(10, 120))) for _ in range(6)]
    texts = [edited(draw, draw.choice(base), draw.randrange(0, 4)) for _ in range(60)] + ["a" * 300, "ab" * 150, None, "", "xyz " * 100, base[0], base[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    made = repeats.without_repeats(frame, 40, 27, 5, group).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in made}
    assert got == dict(enumerate(cut_by_hand(texts, 40)))


def test_repeats_in_chunks(spark, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(repeats, "CHUNK", 64)
    raw = np.frombuffer((prose(draw, 150) * 2).encode(), dtype=np.uint8)
    s, owned, *_ = repeats.contexts(raw, 40, 27)
    assert sorted(a for x, n in zip(s, owned) for a in range(x, x + n)) == list(range(len(raw) - 39))


def test_repeats_odd_rows(odd, clashing, empty):
    cut = repeats.cut_repeats(clashing)
    assert cut.columns == clashing.columns and cut.dtypes == clashing.dtypes and cut.count() == clashing.count()
    by_id = collections.defaultdict(list)
    for r in cut.collect():
        by_id[r["doc_id"]].append(r["text"])
    # the prose of 1 and 6 is shorter than 400 bytes
    assert by_id[2] == [None] and by_id[3] == [""] and by_id[8] == [""] and by_id[6] == by_id[1] * 2
    assert by_id[None] == ["A text without an id, which is kept as it is."]
    assert repeats.cut_repeats(empty).count() == 0
    expected = collections.Counter(x[:3] for x in cut_by_hand([r["text"] for r in odd.collect() if r["doc_id"] != 4], 400))
    got = collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.without_repeats(odd.filter("doc_id IS NULL OR doc_id <> 4")).collect())
    assert got == expected


def tile_by_hand(item, doc, least):
    least = min(least, len(item))
    a, b, total = [0] * len(item), [0] * len(doc), 0
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best.append((n, -i, -j))
        n, i, j = max(best, default=(0, 0, 0))
        if n < max(1, least):
            return total
        a[-i : -i + n] = [1] * n
        b[-j : -j + n] = [1] * n
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.lists(st.integers(0, 3), max_size=24), st.integers(1, 4), st.sampled_from([2, 5, 20]))
def test_tiling(item, doc, least, start):
    got = decontamination.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), least, start)
    for i, d, n in got:
        assert item[i : i + n] == doc[d : d + n] and n >= min(least, len(item))
    assert sum(n for *_, n in got) == tile_by_hand(item, doc, least)


def test_decontamination(spark, odd, clashing, empty):
    draw = random.Random(3)
    items = [prose(draw, n) for n in (40, 24, 3, 12)] + [None, "", "..."]
    a = items[0].split(" ")
    docs = [
        prose(draw, 50) + " " + items[0] + " " + prose(draw, 20),
        " ".join(a[20:]) + " x y z " + " ".join(a[:20]),  # in another order
        " ".join(a[:10]) + " " + prose(draw, 90),  # a quarter
        items[2].upper() + "! " + prose(draw, 9), items[3], prose(draw, 100), None, "",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(3)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["n_tiles"]) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == {(0, 0): (40, 1), (1, 0): (40, 2), (3, 2): (3, 1), (4, 3): (12, 1)}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(frame, bench).collect()) == [2, 5, 6, 7]
    assert decontamination.without_leaks(clashing, bench).columns == clashing.columns
    assert decontamination.without_leaks(odd, bench).count() == odd.count()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(frame, none).count() == 0 == decontamination.contaminated(empty, bench).count()
    own = spark.createDataFrame([(5, "A text without an id, which is kept as it is.")], "item_id long, text string")
    assert decontamination.without_leaks(odd, own).count() == odd.count() - 1


def test_passages(spark, odd, clashing, empty):
    draw = random.Random(6)
    shared, other = prose(draw, 51), prose(draw, 51)
    docs = [prose(draw, 80) for _ in range(12)]
    for i in (1, 4, 9):
        docs[i] = docs[i] + " " + shared + ", " + prose(draw, 30)
    docs[7] = other.upper() + " " + docs[7]
    docs[8] = docs[8] + " " + other
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    rows = passages.repeated_passages(frame).collect()
    assert {r["doc_id"] for r in rows} == {1, 4, 7, 8, 9}
    assert {r["doc_id"] for r in rows if r["removed"]} == {4, 8, 9}
    words = [normal_words(d) for d in docs]
    for r in rows:
        a = words[r["doc_id"]][r["word_start"] : r["word_start"] + r["n_words"]]
        b = words[r["class_doc_id"]][r["class_word_start"] : r["class_word_start"] + r["n_words"]]
        # the same words, or shifted by one
        assert a == b or a[1:] == b[:-1] or a[:-1] == b[1:]
    assert {r["doc_id"] for r in passages.repeated_passages(clashing).filter("removed AND doc_id < 9").collect()} <= {1, 4, 6}
    assert passages.repeated_passages(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_a_shared_run_of_words_shares_a_paragraph(seed):
    draw = np.random.default_rng(seed)
    common = draw.integers(0, 2**63, passages.SIZE + passages.SPAN + 1, dtype=np.uint64)
    prints = []
    for _ in range(2):
        words = np.concatenate([draw.integers(0, 2**63, int(draw.integers(0, 90)), dtype=np.uint64), common, draw.integers(0, 2**63, int(draw.integers(0, 90)), dtype=np.uint64)])
        prints.append(set(passages.paragraphs(words)[1].tolist()))
    assert prints[0] & prints[1]


def test_crowded_nodes_are_split_once(spark):
    """40 nodes of three components under 20 crowded keys: a split gets each node once, and all links are found."""
    rows = spark.createDataFrame([(n, 100, key) for n in range(40) for key in range(20)], "node long, size int, key long")
    given_rows, same = [], lambda c: c % 3

    def split(nodes):
        given_rows.append((nodes.count(), nodes.select("node").distinct().count()))
        return nodes.select(F.xxhash64("crowd", (F.col("node") % 3)).alias("key"), "node", "size", "root")

    verify = lambda pairs: pairs.filter(same(F.col("a")) == same(F.col("b")))
    found = graph.links(graph.colliding(rows), verify, 0.8, splits=[split, split])
    roots = {r["node"]: r["root"] for r in graph.components(found).collect()}
    assert [a for a, _ in given_rows][0] == 40 and all(a == b for a, b in given_rows)
    assert roots == {n: n % 3 for n in range(40)}


def test_crowded_keys_are_kept_in_blocks(spark, monkeypatch):
    """300 nodes with 20 finer keys each: a crowded finer key carries a few rows on, not one for each of its nodes."""
    rows = spark.createDataFrame([(n, 100, 1) for n in range(300)], "node long, size int, key long")
    made = {}

    def counted(df, name):
        table = written(df, name)
        made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(graph, "written", counted)
    split = lambda nodes: nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda u: F.xxhash64("crowd", u))).alias("key"), "node", "size", "root")
    verify = lambda pairs: pairs.filter("a % 3 = b % 3")
    found = graph.links(graph.colliding(rows), verify, 0.8, splits=[split])
    assert {r["node"]: r["root"] for r in graph.components(found).collect()} == {n: n % 3 for n in range(300)}
    assert made["finer-keys"] <= 20 * (1 + 300 // graph.BLOCK)


def test_places_without_repeats_are_not_shuffled(spark, monkeypatch):
    draw = random.Random(3)
    texts = [prose(draw, 300) for _ in range(40)]
    texts.append(prose(draw, 20) + texts[0] + prose(draw, 20))
    passed = []

    def seen(rows, *more):
        out = repeats_filter(rows, *more)
        if "starts" in rows.columns:
            passed.append((out.count(), out.filter("maybe").count()))
        return out

    repeats_filter = repeats.may_match
    monkeypatch.setattr(repeats, "may_match", seen)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.without_repeats(frame, 40, 27, 5).collect()}
    assert got == dict(enumerate(cut_by_hand(texts, 40)))
    assert len(passed) == 1 and passed[0][1] < passed[0][0] / 4


def test_edit_distance_of_far_texts():
    """Texts with more edits than diagonals are followed for, against the full table."""
    draw = random.Random(11)
    for _ in range(150):
        a = [draw.randrange(12) for _ in range(draw.randrange(1, 120))]
        b = [x for x in a if draw.random() > 0.3] if draw.random() < 0.5 else [draw.randrange(12) for _ in range(draw.randrange(1, 120))]
        limit, far = draw.randrange(0, 110), edit_distance(a, b)
        assert near_duplicates.edit_distance_within(np.array(a, dtype="<u4"), np.array(b, dtype="<u4"), limit) == min(far, limit + 1)
        if b:
            assert near_duplicates._by_columns(a, b, limit) == min(far, limit + 1)


def test_paragraphs_of_several_texts_at_once():
    """Short, empty, repetitive and long texts side by side have the paragraphs that each has alone."""
    draw = random.Random(17)
    texts = [np.array([draw.randrange(1, draw.choice((2, 3, 500))) for _ in range(n)], dtype=np.uint64) for n in (0, 15, 16, 17, 47, 48, 49, 50, 300, 0, 2000, 90)]
    texts += [np.ones(100, dtype=np.uint64), texts[8].copy()]
    number, at, prints, keys = passages.paragraphs_of(texts)
    for i, words in enumerate(texts):
        alone = passages.paragraphs(words)
        assert all(np.array_equal(x[number == i], y) for x, y in zip((at, prints, keys), alone, strict=True))
    assert not len(passages.paragraphs_of([texts[0]])[1])


def test_every_word_lies_in_a_paragraph():
    """Texts of any length and of one repeated word are cut without gaps, whatever stands beside them."""
    draw = random.Random(19)
    sizes = [0, 3, 15, 16, 17, 31, 32, 33, 47, 48, 49, 50, 64, 100, 333, 2000]
    texts = [np.array([draw.randrange(1, many) for _ in range(n)], dtype=np.uint64) for n in sizes for many in (2, 3, 400)]
    draw.shuffle(texts)
    number, at, _, _ = passages.paragraphs_of(texts)
    for i, words in enumerate(texts):
        mine = at[number == i]
        covered = np.zeros(len(words), dtype=bool)
        for a in mine:
            covered[a : a + passages.SIZE] = True
        assert covered.all() if len(words) >= passages.SIZE else not len(mine)
        assert len(set(mine)) == len(mine) and not len(mine) or 0 <= mine.min() <= mine.max() <= len(words) - passages.SIZE
        assert set(passages.starts(words)) <= set(mine)


def test_words_between_cuts_are_reported(spark):
    """A passage of 300 words that two texts share is reported but for its ends."""
    draw = random.Random(23)
    passage = prose(draw, 300).split()
    docs = [" ".join(prose(draw, 70).split() + passage + prose(draw, 70).split()) for _ in range(2)]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    for doc in (0, 1):
        words = normal_words(docs[doc])
        begin = next(i for i in range(len(words)) if words[i : i + 20] == normal_words(" ".join(passage))[:20])
        held = {w for r in rows if r["doc_id"] == doc for w in range(r["word_start"], r["word_start"] + r["n_words"])}
        inside = range(begin + passages.SPAN + passages.SIZE, begin + 300 - passages.SPAN - passages.SIZE)
        assert set(inside) <= held
