"""Passages that repeat across documents or within one: MinHash banding over content-cut paragraphs.

Pasted text rarely keeps to lines, so the paragraphs are cut by content: where the hash of three words is the least
among ``SPAN`` neighbours, a paragraph of ``SIZE`` words begins. Two texts that share ``SIZE`` + ``SPAN`` + 1 words in a
row therefore share a paragraph, wherever it stands; here that is 50 words. What these paragraphs leave over gets
paragraphs of ``SIZE`` words too, placed by the cuts beside it (``gapless``), so that every word of a text lies in one.
Words are lower-case runs of letters and digits.

Paragraphs with equal words are one node. Nodes are banded by MinHash over their runs of ``K`` words, ``BANDS`` bands of
``ROWS`` values: at a Jaccard index of 0.8 a pair collides with a probability of 0.95, equal ones always. Colliding
nodes are verified by the exact Jaccard index of their runs (repeated runs count each), and classes are the components of the links. Paragraphs of
one class that overlap in one text are one occurrence. Of each class with several occurrences the first by (doc_id,
place) stays, all others are to be removed.

Defined cases: null texts, and texts shorter than ``SIZE`` words, have no paragraphs; repeated rows with one doc_id are
one occurrence; rows with a null doc_id are left out; no content cut falls into a
stretch of one repeated word; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccensus.llm.graph import colliding, components, links
from doccensus.llm.shared import written
from doccensus.llm.words import WordNumbers, mix, shingles

SIZE, SPAN, K, SIMILARITY = 16, 33, 5, 0.8
BANDS, ROWS = 3, 2
_SEEDS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def starts(words: np.ndarray) -> np.ndarray:
    """Where paragraphs begin."""
    n = len(words) - SIZE + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    marks = shingles(words, 3)
    ranked = (mix(marks) & ~_PLACE) | np.arange(len(marks), dtype=np.uint64) & _PLACE
    ranked[1:][marks[1:] == marks[:-1]] |= ~_PLACE
    ranked = ranked[:n]
    least = _sliding_min(ranked, min(SPAN, n))
    least = least[(least | _PLACE) != np.uint64(2**64 - 1)]
    low = np.unique(least & _PLACE).astype(np.int64)
    if len(words) <= int(_PLACE):
        return low
    # places are known up to the mask only; longer texts are searched for them
    at = np.flatnonzero(np.isin(ranked, least))
    return at


def _steps(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the distances ``far`` and how far in it: marks ``SIZE`` apart, the last but one halfway and the last at its end."""
    n = -(-far // SIZE)
    of = np.repeat(np.arange(len(n)), n)
    left = n[of] - np.arange(n.sum()) + np.repeat(np.cumsum(n) - n, n)
    even = SIZE * (n[of] - left + 1)
    half = (SIZE * (n[of] - 2) + far[of] + 1) // 2
    return of, np.where(left > 2, even, np.where(left == 2, half, far[of]))


def gapless(cuts: np.ndarray, text: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of paragraphs that cover every word of the texts of ``SIZE`` words or more: the ``cuts``, others at even
    distances between two of them, and one after the other from the last cut on and from the first one back. With them,
    whether a paragraph is there for a single word at the end of a text, beside a cut whose paragraph has all others."""
    bare = np.setdiff1d(np.flatnonzero(sizes >= SIZE), text)
    cuts, text = np.concatenate([cuts, first[bare]]), np.concatenate([text, bare])
    order = np.argsort(cuts)
    cuts, text = cuts[order], text[order]
    last, heads, inner = np.flatnonzero(np.diff(text, append=-1)), np.flatnonzero(np.diff(text, prepend=-1)), np.flatnonzero(np.diff(text) == 0)
    apart = cuts[inner + 1] - cuts[inner]
    n = np.maximum(-(-apart // SIZE) - 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    between = cuts[inner][of] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) * apart[of] // (n[of] + 1)
    of, far = _steps((first + sizes)[text[last]] - SIZE - cuts[last])
    on = cuts[last][of] + far
    of, far = _steps(cuts[heads] - first[text[heads]])
    at = np.unique(np.concatenate([cuts, between, on, cuts[heads][of] - far]))
    return at, ~np.isin(at, cuts) & (np.isin(at - 1, cuts[last]) & np.isin(at + SIZE, first + sizes) | np.isin(at + 1, cuts[heads]) & np.isin(at, first))


def _own_keys(prints: np.ndarray) -> np.ndarray:
    """Band keys that equal paragraphs have in common only: one that is another but for a word would link it to a third that
    is two words off."""
    return mix(prints[:, None] + np.arange(1, BANDS + 1, dtype=np.uint64))


def paragraphs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, prints of the words, and band keys (one row for each paragraph)."""
    at = starts(words)
    at, beside = gapless(at, np.zeros(len(at), dtype=np.int64), np.zeros(1, dtype=np.int64), np.array([len(words)]))
    if not len(at):
        return at, np.empty(0, dtype=np.uint64), np.empty((0, BANDS), dtype=np.uint64)
    runs = shingles(words, K)
    keys = np.empty((len(at), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ _sliding_min(mix(runs ^ _SEEDS[band * ROWS + row]), SIZE - K + 1)[at])
        keys[:, band] = key
    prints = np.zeros(len(at), dtype=np.uint64)
    for i in range(SIZE):
        prints = mix(prints * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    keys[beside] = _own_keys(prints[beside])
    return at, prints, keys


def labelled_runs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted hashes of the runs of the paragraphs that begin ``at``, one row each; repeated runs are told apart, so that
    every paragraph has as many."""
    runs = np.sort(shingles(words, K)[at[:, None] + np.arange(SIZE - K + 1)], axis=1)
    number = np.zeros(runs.shape, dtype=np.uint64)
    same = runs[:, 1:] == runs[:, :-1]
    for j in np.flatnonzero(same.any(axis=0)):
        number[:, j + 1] = np.where(same[:, j], number[:, j] + np.uint64(1), np.uint64(0))
    return np.sort(mix(runs + number * np.uint64(0xD1B54A32D192ED03)), axis=1)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts in one array, and where each text begins in it."""
    return np.concatenate(texts), np.cumsum([0, *map(len, texts)])[:-1]


def paragraphs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, start, print and band keys of each paragraph: ``paragraphs`` of several texts at once."""
    words, first = _joined(texts)
    sizes = np.array([len(t) for t in texts])
    windows = sizes - SIZE + 1
    plain = (windows >= SPAN) & (windows < int(_PLACE) - SIZE)
    found = [first[i] + starts(texts[i]) for i in np.flatnonzero(~plain & (windows > 0))]
    if plain.any():
        marks = shingles(words, 3)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(marks)]
        ranked = (mix(marks) & ~_PLACE) | (np.arange(len(marks)) - first[owner]).astype(np.uint64)
        ranked[1:][(marks[1:] == marks[:-1]) & (owner[1:] == owner[:-1])] |= ~_PLACE
        least = _sliding_min(ranked, SPAN)
        # the stretches that lie in the windows of one text
        inside = (np.arange(len(least)) - first[owner[: len(least)]] <= (windows - SPAN)[owner[: len(least)]]) & plain[owner[: len(least)]]
        inside &= (least | _PLACE) != np.uint64(2**64 - 1)
        hit = np.zeros(len(words), dtype=bool)
        hit[first[owner[: len(least)][inside]] + (least[inside] & _PLACE).astype(np.int64)] = True
        found.append(np.flatnonzero(hit))
    at = np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    at, beside = gapless(at, np.searchsorted(first + sizes, at, side="right"), first, sizes)
    text = np.searchsorted(first + sizes, at, side="right")
    if not len(at):
        return text, at, np.empty(0, dtype=np.uint64), np.empty((0, BANDS), dtype=np.uint64)
    runs = shingles(words, K)[at[:, None] + np.arange(SIZE - K + 1)]
    keys = np.empty((len(at), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ mix(runs ^ _SEEDS[band * ROWS + row]).min(axis=1))
        keys[:, band] = key
    prints = np.zeros(len(at), dtype=np.uint64)
    for i in range(SIZE):
        prints = mix(prints * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    keys[beside] = _own_keys(prints[beside])
    return text, at - first[text], prints, keys


def _cut(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                text, at, prints, keys = paragraphs_of([numbers(t if isinstance(t, str) else None) for t in part["text"]])
                made = {"doc_id": part["doc_id"].to_numpy(dtype=np.int64)[text], "at": at.astype(np.int32), "node": prints.view(np.int64)}
                yield pd.DataFrame(made | {f"key{i}": keys[:, i].copy().view(np.int64) for i in range(BANDS)})

    schema = "doc_id long, at int, node long, " + ", ".join(f"key{i} long" for i in range(BANDS))
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, schema)


def _runs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """node and its words, read again from one document that holds it."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "node")).alias("places"))  # bounded by the text's own length
    by_doc = by_doc.select("doc_id", F.col("places.at").alias("ats"), F.col("places.node").alias("nodes"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(by_doc, "doc_id")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                texts = [numbers(t if isinstance(t, str) else None) for t in part["text"]]
                words, first = _joined(texts)
                # a document of several texts may lack the place
                held = [np.asarray(a) + SIZE <= len(t) for a, t in zip(part["ats"], texts, strict=True)]
                at = np.concatenate([np.asarray(a)[h] + f for a, h, f in zip(part["ats"], held, first, strict=True)]).astype(np.int64)
                if not len(at):
                    continue
                runs = labelled_runs(words, at)
                # the sum of all but one: equal for any two paragraphs that differ in one run
                parts = mix(runs)
                but_one = (parts.sum(axis=1, keepdims=True) - parts).view(np.int64)
                raw, width = runs.tobytes(), runs.shape[1] * 8
                node = np.concatenate([np.asarray(n)[h] for n, h in zip(part["nodes"], held, strict=True)]).astype(np.int64)
                yield pd.DataFrame({"node": node, "runs": [raw[i : i + width] for i in range(0, len(raw), width)], "all_but_one": list(but_one)})

    return written(read.select("text", "ats", "nodes").mapInPandas(rows, "node long, runs binary, all_but_one array<long>").dropDuplicates(["node"]), "runs")


def _verified(pairs: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose runs have the Jaccard index; the runs of a node are few, so arrays on the JVM do."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = []
            for x, y in zip(b["ra"], b["rb"], strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            yield b.loc[hit, ["a", "b"]]

    a, z = runs.select(F.col("node").alias("a"), F.col("runs").alias("ra")), runs.select(F.col("node").alias("b"), F.col("runs").alias("rb"))
    return pairs.join(a, "a").join(z, "b").select("a", "b", "ra", "rb").mapInPandas(rows, "a long, b long")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, word_start, n_words, class_doc_id, class_word_start, removed: all occurrences of repeated paragraphs."""
    cut = written(_cut(docs), "paragraphs")
    nodes = cut.select("node", F.lit(SIZE).alias("size"), F.explode(F.array(*[f"key{i}" for i in range(BANDS)])).alias("key"))
    shared = colliding(nodes)
    held = shared.select("node").distinct()
    places = cut.join(held, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "at")).alias("p")).select("node", "p.*")
    runs = _runs(docs, places)
    # with two differing runs of twelve the index falls under 0.8, so at such limits one key for each run left out is exact
    one_off = (SIZE - K - 1) / (SIZE - K + 3)
    exact = (lambda nodes: nodes.join(runs, "node").select("node", F.explode("all_but_one").alias("key"))) if similarity > one_off else None
    near = components(links(shared.distinct(), lambda pairs: _verified(pairs, runs, similarity), similarity, exact))
    classed = cut.select("doc_id", "at", "node").join(near, "node", "left").select("doc_id", "at", F.coalesce("root", "node").alias("class"))
    # paragraphs of one class that overlap in one text are one occurrence, named by the first of them
    near_by = Window.partitionBy("class", "doc_id").orderBy("at")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(near_by) >= SIZE, F.lit(True))
    placed = classed.withColumn("fresh", fresh).withColumn("head", F.last(F.when(F.col("fresh"), F.col("at")), ignorenulls=True).over(near_by))
    placed = written(placed, "occurrences")
    first = placed.groupBy("class").agg(F.min(F.struct("doc_id", "head")).alias("first"), F.count_if("fresh").alias("n")).filter("n > 1")
    return placed.join(first, "class").select(
        "doc_id", F.col("at").alias("word_start"), F.lit(SIZE).alias("n_words"), F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.head").alias("class_word_start"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("head") != F.col("first.head"))).alias("removed"),
    )
