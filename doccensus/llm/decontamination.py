"""Benchmark items found in documents by greedy string tiling.

Words are lower-case runs of letters and digits. A seed is a run of ``MIN_MATCH`` words (of all its words for a shorter
item). Documents that share a seed with an item are tiled against it: the longest common runs of words that do not
overlap earlier tiles are marked, found by Karp-Rabin hashes over windows whose length falls from ``START`` to
``MIN_MATCH``. The item is reported where tiles cover ``COVERAGE`` or more of its words, in whatever order they stand
in the document.

How it runs: the seeds of the benchmark set the bits of a fixed filter of 2^``BITS`` bits, which the tasks that read
the documents hold; only documents with a run that passes go on, with their words, and meet the seeds in an equi-join
that Spark plans by size. The filter only spares work: what it lets through wrongly falls away in the join.

Defined cases: null or empty texts and items match nothing; repeated documents are reported each, repeated pairs of one
(doc_id, item_id) once for each row; a null doc_id or item_id is carried; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccensus.llm.shared import may_match, tidy, written
from doccensus.llm.words import WordNumbers, shingles

MIN_MATCH, START, COVERAGE, BITS = 5, 20, 0.5, 23
RESULT = "doc_id long, text_hash long, item_id long, item_words int, covered int, n_tiles int, longest int, tiles array<struct<item_start:int,doc_start:int,length:int>>"
_RATIO = 0x9E3779B97F4A7C15


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin: the hash of every window of ``length`` words, running over prefix sums modulo 2^64."""
    powers = np.full(len(words) + 1, _RATIO, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    back = np.full(len(words) + 1, pow(_RATIO, -1, 2**64), dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    n = len(words) - length + 1
    return (sums[length:] - sums[:n]) * back[:n] if n > 0 else np.empty(0, dtype=np.uint64)


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[: len(sums) - length])


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH, start: int = START) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of greedy string tiling, in the order in which they are marked."""
    min_match = min(min_match, len(item))
    if not min_match:
        return []
    in_item, in_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(start, len(item), len(doc)))
    while True:
        matches = _maximal(item, doc, in_item, in_doc, length)
        if matches and matches[0][0] > 2 * length:
            length = matches[0][0]
            continue
        marked = False
        for n, i, d in matches:
            if not in_item[i : i + n].any() and not in_doc[d : d + n].any():
                in_item[i : i + n] = in_doc[d : d + n] = True
                found.append((i, d, n))
                marked = True
        if marked:
            continue  # what was left of overlapped matches may still be as long
        if length == min_match:
            return found
        length = max(min_match, length // 2)


def _maximal(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(length, item start, document start) of unmarked matches that cannot be extended, the longest first."""
    if length > min(len(item), len(doc)):
        return []
    ai, ad = _free_windows(in_item, length), _free_windows(in_doc, length)
    hi, hd = _window_hashes(item, length)[ai], _window_hashes(doc, length)[ad]
    hit = np.isin(hd, hi)
    ad, hd = ad[hit], hd[hit]
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    counts = up - lo
    d = np.repeat(ad, counts)
    i = ai[order][np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    before = (i > 0) & (d > 0)
    inner = before.copy()
    inner[before] = (item[i[before] - 1] == doc[d[before] - 1]) & ~in_item[i[before] - 1] & ~in_doc[d[before] - 1]
    out = []
    for x, y in zip(i[~inner].tolist(), d[~inner].tolist(), strict=True):
        room = min(len(item) - x, len(doc) - y)
        same = (item[x : x + room] == doc[y : y + room]) & ~in_item[x : x + room] & ~in_doc[y : y + room]
        n = room if same.all() else int(np.argmin(same))
        if n >= length:
            out.append((n, x, y))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def _seed_runs(words: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    runs = [shingles(words, k) for k in sizes if len(words) >= k]
    return np.unique(np.concatenate(runs)) if runs else np.empty(0, dtype=np.uint64)


def _bits(seeds: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << BITS) - 1)
    return np.stack([seeds & mask, (seeds >> np.uint64(32)) & mask]).astype(np.int64)


def benchmark_words(benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """item_id, item (its words as bytes), size (of its seeds), seeds; items without words are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        for b in batches:
            out = []
            for item_id, text in zip(b["item_id"].astype("Int64"), b["text"], strict=True):
                words = numbers(text if isinstance(text, str) else None)
                if len(words):
                    size = min(min_match, len(words))
                    out.append((item_id, words.tobytes(), size, _seed_runs(words, (size,)).view(np.int64)))
            frame = pd.DataFrame(out, columns=["item_id", "item", "size", "seeds"])
            frame["item_id"] = frame["item_id"].astype("Int64")
            yield frame

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInPandas(rows, "item_id long, item binary, size int, seeds array<long>")


def _filter(items: DataFrame) -> np.ndarray:
    """The bits of all seeds: at most 2^BITS / 64 numbers come to the driver, whatever the benchmark's size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            for seeds in b["seeds"]:
                held[_bits(np.asarray(seeds, dtype=np.int64).view(np.uint64)).ravel()] = True
        words = np.packbits(held, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pd.DataFrame({"at": at, "bits": words[at]})

    got = items.select("seeds").mapInPandas(rows, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros((1 << BITS) // 64, dtype="<i8")
    out[got["at"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """One row per document and benchmark item that it holds, with the tiles; see ``RESULT``."""
    items = written(benchmark_words(benchmark, min_match), "benchmark")
    sizes = tuple(sorted(r[0] for r in items.select("size").distinct().toPandas().itertuples(index=False)))  # at most min_match numbers
    bits = _filter(items)

    @tidy
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = WordNumbers()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc_id, text, print_ in zip(b["doc_id"].astype("Int64"), b["text"], b["text_hash"], strict=True):
                row += 1
                words = numbers(text if isinstance(text, str) else None)
                seeds = _seed_runs(words, sizes)
                if len(seeds):
                    at = _bits(seeds)
                    seeds = seeds[(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1).all(axis=0)]
                if len(seeds):
                    out.append((row, doc_id, print_, words.tobytes(), seeds.view(np.int64)))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "text_hash", "words", "seeds"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    met = written(read.mapInPandas(scan, "row long, doc_id long, text_hash long, words binary, seeds array<long>"), "seeded")
    known = items.select(F.xxhash64("item").alias("item_print"), F.explode("seeds").alias("seed")).distinct()
    pairs = met.select("row", F.explode("seeds").alias("seed")).join(known, "seed").select("row", "item_print").distinct()
    # equal items are tiled once and told apart again afterwards
    texts = items.groupBy(F.xxhash64("item").alias("item_print")).agg(F.first("item").alias("item"))
    sides = pairs.join(texts, "item_print").join(met.select("row", "doc_id", "text_hash", "words"), "row")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                item = np.frombuffer(r.item, "<u8")
                got = tiles(item, np.frombuffer(r.words, "<u8"), min_match)
                covered = sum(t[2] for t in got)
                if got and covered >= coverage * len(item):
                    out.append((r.doc_id, r.text_hash, r.item_print, len(item), covered, len(got), max(t[2] for t in got), got))
            frame = pd.DataFrame(out, columns=["doc_id", "text_hash", "item_print", "item_words", "covered", "n_tiles", "longest", "tiles"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    found = sides.select(F.col("doc_id"), "text_hash", "item_print", "item", "words").mapInPandas(tile, RESULT.replace("item_id", "item_print"))
    names = items.select(F.xxhash64("item").alias("item_print"), "item_id")
    return found.join(names, "item_print").select(*[x.split()[0] for x in RESULT.split(", ")])


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows are told by doc_id and text."""
    leaks = written(contaminated(docs, benchmark, coverage).select("doc_id", "text_hash").distinct(), "leaks")
    row = F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), row)
    # rows that the filter lets pass are not shuffled
    marked = may_match(rows, F.col("text_hash"), leaks, "text_hash")
    mark = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    left = marked.filter("NOT maybe").select("row").unionByName(marked.filter("maybe").alias("a").join(leaks.alias("b"), mark, "left_anti").select("row"))
    return left.select(*[F.col("row")[x].alias(x) for x in docs.columns])
