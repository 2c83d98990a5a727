"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-case runs of letters and digits. Texts with equal words form a class at once; what follows works on
one text of each class. Its runs of ``K`` words are labelled with their occurrence number. Each of ``SKETCHES``
sketches takes the ``LENGTH`` labelled runs of least hash and lists them in text order; the list is hashed to one band
key. Order MinHash collides the likelier the smaller the edit distance, and not for the same runs in another order.
Texts with a common band key whose lengths allow it are candidates. A candidate is verified by a banded alignment of
the words: the pair is linked when 1 - edits / (words of the longer text) is ``SIMILARITY`` or more. A pair whose
runs have a Jaccard index of 0.8 shares some key with a probability over 0.9999, at 0.6 of 0.97.

How hot keys are treated: every text of a key is first held against the least text of the key (one row for each text
and key). Components of these links are found, and only keys that still hold texts of different components give
further pairs, those between the components. There the texts that crowded keys connect are split, once for each text and
not for each of its keys, by an exact bound: ``e`` edits change at most ``e`` words and 2 ``e`` pairs of neighbouring words, so of two similar texts, both with these in one common order,
the first ones have one in common. The order is by how often each occurs, so a passage that many texts share comes
last and pairs none of them. Each pair left is verified once, so no link between texts of a key is left out; copies and
texts that are already linked are not paired.

Defined cases: a null text, and one without words, is a class of its own; texts with fewer than ``K`` words count as one
run; repeated rows with one ``doc_id`` are one document, its text the least one in order; a null ``doc_id`` is kept as
a class of its own; an empty table gives no rows; other columns are ignored. ``keep_one`` goes by rows instead of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccensus.llm.graph import colliding, components, links
from doccensus.llm.shared import may_match, release, tidy, written
from doccensus.llm.words import WordNumbers, mix, shingles

K, SIMILARITY = 5, 0.8
SKETCHES, LENGTH = 20, 3
#: the counts that order word pairs are kept by this many bits of their hash; the order bounds the work, not the result
COUNT_BITS = 20
_PART_BITS = 12
#: edits up to which diagonals are followed
FEW_EDITS = 24
_SEEDS = np.random.default_rng(1).integers(1, 2**63, SKETCHES, dtype=np.uint64)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Hashes of the runs in which equal runs are told apart by their occurrence number."""
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    first = np.empty(n, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_runs[1:] != sorted_runs[:-1]]))
    first[:] = np.repeat(starts, np.diff(np.append(starts, n)))
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = (np.arange(n) - first).astype(np.uint64)
    return mix(runs + occurrence * np.uint64(0xD1B54A32D192ED03))


def order_min_hash(runs: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """One key for each sketch; runs of equal hash are told apart by their occurrence number."""
    n, numbered = len(runs), labelled(runs)
    hashed = mix(numbered[None, :] ^ np.resize(_SEEDS, sketches)[:, None])
    take = min(length, n)
    least = np.argpartition(hashed, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), (sketches, n))
    listed = numbered[np.sort(least, axis=1)]
    out = np.arange(1, sketches + 1, dtype=np.uint64)
    for i in range(take):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ listed[:, i])
    return out


def units(words: np.ndarray, length: int) -> np.ndarray:
    """Labelled words (``length`` 1), or pairs of neighbouring words (2) with one before the first and after the last."""
    if length == 1:
        return labelled(mix(words.astype(np.uint64)))
    edge = np.zeros(1, dtype=np.uint64)
    return labelled(shingles(np.concatenate([edge, words.astype(np.uint64) + np.uint64(1), edge]), 2))


def most_changed(n: int, similarity: float, length: int) -> int:
    """How many of the units of a text of ``n`` words a similar text of its length or more can lack.

    A word replaced or deleted takes away one word or two pairs, a word inserted no word or one pair; with a longer text of
    m words, m - n words at least are inserted. A shorter similar text is allowed no more edits than one of ``n`` words.
    """
    longer = np.arange(n, int(n / similarity + 1e-9) + 1)
    return int((length * np.floor((1 - similarity) * longer + 1e-9) - (longer - n)).max())


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def first_units(words: np.ndarray, often: np.ndarray, similarity: float, length: int) -> np.ndarray:
    """The rarest units of a text, one more than a similar text can lack; any two similar texts have a common one."""
    found = units(words, length)
    take = most_changed(len(words), similarity, length) + 1
    return found[np.lexsort((found, often[_bucket(found)]))[:take]]


def _by_columns(a: list[int], b: list[int], limit: int) -> int:
    """Edits between two word sequences, ``limit`` + 1 where there are more: Myers' columns of differences, a bit a word."""
    n, places = len(a), {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << n) - 1
    up, down, edits, rest = every, 0, n, len(b)
    for w in b:
        rest -= 1
        same = places.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(across | up), up & across
        edits += (more >> n - 1) - (less >> n - 1)
        if edits - rest > limit:
            return limit + 1
        more, same = more << 1 | 1, same | down
        up, down = (less << 1 | ~(same | more)) & every, more & same & every
    return min(edits, limit + 1)


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits (insert, delete, replace) between two word sequences, ``limit`` + 1 where there are more.

    Only diagonals up to ``limit`` from the main one are kept. ``reach[d]`` is how far into ``a`` the first e edits come
    on each diagonal; runs of equal words are followed without cost, so the work is about the square of the edits. Texts
    that differ by more than ``FEW_EDITS`` are aligned column by column instead.
    """
    head = min(len(a), len(b))
    same = a[:head] == b[:head]
    at = head if same.all() else int(np.argmin(same))
    a, b = a[at:], b[at:]
    head = min(len(a), len(b))
    if head:
        same = a[-head:][::-1] == b[-head:][::-1]
        end = head if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if not n or not m:
        return min(n + m, limit + 1)
    if abs(n - m) > limit:
        return limit + 1
    goal, left, right = m - n, a.tolist(), b.tolist()

    def follow(x: int, diagonal: int) -> int:
        y = x + diagonal
        while x < n and y < m and left[x] == right[y]:
            x += 1
            y += 1
        return x

    reach = {0: follow(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for edits in range(1, min(limit, FEW_EDITS) + 1):
        nxt = {}
        for d in range(max(-edits, -n), min(edits, m) + 1):
            if abs(d - goal) > limit - edits:
                continue
            x = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -1))
            if x < 0:
                continue
            nxt[d] = follow(min(x, n, m - d), d)
        if nxt.get(goal, -1) >= n:
            return edits
        reach = nxt
        if not reach:
            return limit + 1
    return _by_columns(left, right, limit) if limit > FEW_EDITS else limit + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length is ``similarity`` or more."""
    longer = max(len(a), len(b))
    limit = int(np.floor((1 - similarity) * longer + 1e-9))
    if longer - min(len(a), len(b)) > limit:
        return False
    # words that only one side has need an edit each: a bound that spares most alignments of unlike texts
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return False
    return edit_distance_within(a, b, limit) <= limit


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, print (of all words), n_words, words (64-bit numbers as bytes), keys; texts without words are left out."""
    schema = "doc_id long, print binary, n_words int, words binary, keys array<long>"

    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        numbers = WordNumbers()
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                part = batch.iloc[at : at + 256]
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    words = numbers(text if isinstance(text, str) else None)
                    if len(words):
                        raw = words.tobytes()
                        keys = order_min_hash(shingles(words, K)).view(np.int64)
                        # the words' lower halves are enough to align; equal texts are told by the whole print
                        out.append((doc_id, blake2b(raw, digest_size=16).digest(), len(words), words.astype("<u4").tobytes(), keys))
                yield pd.DataFrame(out, columns=["doc_id", "print", "n_words", "words", "keys"])

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, schema)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words align."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [
                similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity)
                for x, y in zip(batch["wa"], batch["wb"], strict=True)
            ]
            yield batch.loc[hit, ["a", "b"]]

    a = texts.select(F.col("doc_id").alias("a"), F.col("words").alias("wa"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "wa", "wb").mapInPandas(rows, "a long, b long")


def _often(words: DataFrame, length: int) -> np.ndarray:
    """A byte for each bucket of units: eight steps for each doubling of their count.

    A task counts what it has read and hands on at most a row for each of ``1 << COUNT_BITS - _PART_BITS`` parts, so the rows
    follow the tasks and not the words of the texts; the parts are added up apart.
    """
    part = 1 << _PART_BITS

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for raw in batch["words"]:
                np.add.at(total, _bucket(units(np.frombuffer(raw, "<u4"), length)), 1)
        at = np.flatnonzero(total)
        parts, first = np.unique(at >> _PART_BITS, return_index=True)
        cut = [(np.bitwise_and(x, part - 1).astype("<u2").tobytes(), total[x].astype("<i8").tobytes()) for x in np.split(at, first[1:])] if len(at) else []
        yield pd.DataFrame({"part": parts.astype(np.int32), "at": [x for x, _ in cut], "n": [n for _, n in cut]})

    def added(counted: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, dtype=np.int64)
        for at, n in zip(counted["at"], counted["n"], strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        steps = np.minimum(255, 8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pd.DataFrame({"part": counted["part"].iloc[:1], "steps": [steps.tobytes()]})

    counted = words.select("words").mapInPandas(counts, "part int, at binary, n binary")
    # at most 2^COUNT_BITS bytes
    known = counted.groupBy("part").applyInPandas(added, "part int, steps binary").toArrow()
    often = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    for at, steps in zip(known["part"].to_pylist(), known["steps"].to_pylist(), strict=True):
        often[at * part : (at + 1) * part] = np.frombuffer(steps, np.uint8)
    return often


def _split(nodes: DataFrame, texts: DataFrame, similarity: float, length: int) -> DataFrame:
    """Texts (node, size, root, crowd) by their first units: of one crowd, only those with a common one, the ``key``, can be similar."""
    words = texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    often = _often(words, length)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [first_units(np.frombuffer(raw, "<u4"), often, similarity, length).view(np.int64) for raw in batch["words"]]
            yield pd.DataFrame({"node": batch["doc_id"], "units": made})

    found = words.select("doc_id", "words").mapInPandas(rows, "node long, units array<long>")
    return nodes.join(found, "node").select("node", "size", "root", "crowd", F.explode("units").alias("unit")).select(F.xxhash64("crowd", "unit").alias("key"), "node", "size", "root")


def _splits(texts: DataFrame, similarity: float) -> list[Callable[[DataFrame], DataFrame]]:
    """By word pairs, then, where a passage is most of the texts, by words; under 0.5 all word pairs may be changed."""
    return [lambda nodes, n=n: _split(nodes, texts, similarity, n) for n in (2, 1) if n == 1 or similarity >= 0.5]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    made = written(sketches(docs), "sketches")
    # one text for each document, then one document for each text: aggregates of ids and prints only
    own = made.groupBy("doc_id").agg(F.min("print").alias("print"))
    heads = own.groupBy("print").agg(F.min("doc_id").alias("head"))
    member = written(own.join(heads, "print").select("doc_id", "print", "head"), "members")
    head = member.filter("doc_id = head").select("doc_id", "print")
    texts = made.select("doc_id", "print", "n_words", "keys").join(head, ["doc_id", "print"])

    shared = colliding(texts.select(F.col("doc_id").alias("node"), F.col("n_words").alias("size"), F.explode("keys").alias("key")))
    # the words of all texts that meet another anywhere; all others are read no more
    held = shared.select(F.col("node").alias("doc_id")).distinct().join(head, "doc_id")
    words = written(made.select("doc_id", "print", "words").join(held, ["doc_id", "print"], "left_semi").select("doc_id", "words"), "words")
    release(made)
    final = components(links(shared, lambda pairs: _verified(pairs, words, similarity), similarity, splits=_splits(words, similarity)))
    release(words)
    release(shared)
    heads_root = member.join(final, member["head"] == final["node"], "left").select("doc_id", F.coalesce("root", "head").alias("class_id"))
    return ids.join(heads_root, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near duplicates, the first by (doc_id, place); a null ``doc_id`` comes last.

    Rows, not ids, are compared: repeated rows leave one, and so do equal texts without ids or two texts under one id
    that have other near duplicates. Of texts without words one row for each (doc_id, text) stays.
    """
    # the places must be the same at each reading, so the rows are written with them, nested so that no name can clash
    placed = written(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row")), "placed")
    classes = near_duplicates(placed.select(F.col("at").alias("doc_id"), F.col("row")["text"].alias("text")), similarity).withColumnRenamed("doc_id", "at")
    own = F.col("row")["doc_id"]
    named = placed.select("at", F.struct(own.isNull().alias("no_id"), own.alias("id"), F.col("at").alias("at")).alias("rank"), F.md5(F.col("row")["text"]).alias("text"))
    # ids and hashes only: the first row of each class, and of these the first of each (doc_id, text) for texts without words
    first = classes.join(named, "at").groupBy("class_id").agg(F.min(F.struct("rank", "text")).alias("f"))
    kept = first.groupBy("f.rank.id", "f.text").agg(F.min("f.rank.at").alias("at")).select("at")
    gone = written(named.select("at").join(kept, "at", "left_anti").select("at"), "gone")
    # rows that the filter lets pass are not shuffled; of the others, ids only stand on the right side
    marked = may_match(placed, F.col("at"), gone, "at")
    left = marked.filter("NOT maybe").unionByName(marked.filter("maybe").join(gone, "at", "left_anti"))
    return left.select(*[F.col("row")[x].alias(x) for x in docs.columns])
