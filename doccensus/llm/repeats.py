"""Bytes covered by strings of ``length`` bytes that start anywhere else too, removed exactly.

Every string of ``length`` bytes is owned by its anchor: the place of the least hash among its runs of ``length`` -
``SLACK`` bytes. Equal strings have equal anchors at equal distance, so each can be judged among the strings of one
anchor value alone. The strings that one anchor place owns start side by side; together they are its context, at most
``length`` + ``SLACK`` bytes.

1. Tasks list the contexts of their texts as (anchor hash, context hash). A context that occurs twice or more has only
   repeated strings; an anchor value with a single context has none besides.
2. The other contexts, those of anchor values with several contexts, are read again from one text each.
3. They are grouped by anchor value and told apart by a suffix array (linear grouping, ``suffix_groups``) over blocks of
   ``BLOCK`` bytes that are laid out from the anchor: neighbours in the array with ``CORE`` equal blocks form a class,
   and within a class a string is given by the bytes before and after its blocks.
4. Anchor values with over ``GROUP`` contexts are not gathered. There the strings' cores are counted in a shuffle, and
   the strings of cores that occur in several contexts by their own hash, so a value of any size is spread.
5. The places come back to their texts, and covered bytes are cut out.

Hashes are of 64 bits, of contexts 128; no text is compared with another one. What is carried grows with the texts and
not with pairs of copies.

Defined cases: a null or empty text has no bytes; texts shorter than ``length`` keep all; repeated rows count as texts of
their own, so what they repeat goes from each; a null doc_id is a document like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.llm.passages import _sliding_min
from doccensus.llm.shared import may_match, release, tidy, written
from doccensus.llm.suffix_groups import suffix_array
from doccensus.llm.words import mix

LENGTH, SLACK = 400, 272
BLOCK = 50
#: the same for passages of over 50 words, the shortest of which have about 200 bytes
PASSAGE, PASSAGE_SLACK, PASSAGE_BLOCK = 200, 136, 25
GROUP = 128
CHUNK = 1 << 22
_VALUES = np.random.default_rng(13).integers(0, 2**64, 256, dtype=np.uint64)
_RATIO = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_RATIO), -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)


class Running:
    """Karp-Rabin hashes of any slice of ``raw`` from prefix sums modulo 2^64."""

    _powers = _backs = np.empty(0, dtype=np.uint64)

    def __init__(self, raw: np.ndarray):
        if len(Running._powers) < len(raw) + 1:
            n = max(1 << 20, 1 << (len(raw) + 1).bit_length())
            for name, base in (("_powers", _RATIO), ("_backs", _BACK)):
                table = np.full(n, base, dtype=np.uint64)
                table[0] = 1
                setattr(Running, name, np.cumprod(table, dtype=np.uint64))
        self._sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[raw] * Running._powers[: len(raw)], out=self._sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self._sums[stop] - self._sums[start]) * Running._backs[start]

    def windows(self, width: int) -> np.ndarray:
        n = len(self._sums) - width
        return (self._sums[width:] - self._sums[:n]) * Running._backs[:n]


def contexts(raw: np.ndarray, length: int = LENGTH, slack: int = SLACK) -> tuple[np.ndarray, ...]:
    """(start, strings owned, anchor minus start, anchor hash, context hash) of each anchor place of a text.

    A text is taken in chunks of starts, each with the bytes that its strings reach; every string has one owner.
    """
    found = []
    for base in range(0, max(0, len(raw) - length + 1), CHUNK):
        part = raw[base : base + CHUNK + length - 1]
        running = Running(part)
        grams = mix(running.windows(length - slack))
        least = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), slack + 1) & _PLACE
        s = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        e = np.append(s[1:], len(least)) - 1
        m = least[s].astype(np.int64)
        owned = e - s + 1
        print_ = mix(running.of(s, e + length) ^ mix((owned * 1024 + (m - s)).astype(np.uint64)))
        found.append((s + base, owned, m - s, grams[m], print_))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes(text: object) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else b"", dtype=np.uint8)


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def _both(doc: str, th: str) -> Column:
    return F.xxhash64(doc, th)


def _places(docs: DataFrame, length: int, slack: int) -> DataFrame:
    """doc, th, h, c, owned, ahead and the starts of each context of a text."""

    @tidy
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 128):
                out = []
                part = b.iloc[k : k + 128]
                for doc, th, text in zip(part["doc"], part["th"], part["text"], strict=True):
                    s, owned, ahead, h, c = contexts(_bytes(text), length, slack)
                    if not len(s):
                        continue
                    order = np.lexsort((s, c, h))
                    s, owned, ahead, h, c = s[order], owned[order], ahead[order], h[order].view(np.int64), c[order].view(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])]))
                    starts = np.split(s.astype(np.int32), first[1:])
                    out.append(pd.DataFrame({"doc": doc, "th": th, "h": h[first], "c": c[first], "owned": owned[first], "ahead": ahead[first], "starts": starts}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    schema = "doc long, th long, h long, c long, owned int, ahead int, starts array<int>"
    return docs.select(*_key(), "text").mapInPandas(rows, schema)


def _texts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted contexts with their bytes, each read from the one text that it names."""
    by_doc = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "c", "n", "size", "owned", "ahead", "start")).alias("want"))
    by_doc = written(by_doc, "wanted")
    named = may_match(docs.select(*_key(), "text"), _both("doc", "th"), by_doc.select(_both("doc", "th").alias("k")), "k")
    read = named.filter("maybe").join(by_doc, ["doc", "th"]).select("text", "want")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["h", "c", "n", "size", "owned", "ahead", "raw"]
        for b in batches:
            out = []
            for text, want in zip(b["text"], b["want"], strict=True):
                raw = _bytes(text)
                for w in want:
                    out.append((w["h"], w["c"], w["n"], w["size"], w["owned"], w["ahead"], raw[w["start"] : w["start"] + w["owned"] - 1 + length].tobytes()))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    # repeated rows give a context twice, with the same bytes
    made = read.mapInPandas(rows, "h long, c long, n long, size long, owned int, ahead int, raw binary")
    return written(made, "contexts")


def _spans(ahead: np.ndarray, owned: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """For each string of each context: the context's number, its start, and the bytes before its first whole block."""
    which = np.repeat(np.arange(len(owned)), owned)
    at = np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned)
    return which, at, (ahead[which] - at) % block


def repeated_in_groups(group: np.ndarray, occurs: np.ndarray, owned: np.ndarray, ahead: np.ndarray, raws: list[bytes], length: int = LENGTH, block: int = BLOCK) -> list[np.ndarray]:
    """Which strings of each context occur again in the contexts of its group; all groups of a batch in one suffix array."""
    core = length // block - 1
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
    sizes = np.array([len(r) for r in raws])
    base = np.cumsum(sizes) - sizes
    running = Running(raw)
    first = ahead % block
    blocks = (sizes - first) // block
    text_at = np.cumsum(blocks + 1) - (blocks + 1)  # of each context's first symbol; one separator after each
    which = np.repeat(np.arange(len(raws)), blocks)
    k = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    from_ = base[which] + first[which] + k * block
    prints = mix(running.of(from_, from_ + block) ^ mix(group[which].view(np.uint64)))
    symbols = np.ones(int((blocks + 1).sum()) + 1, dtype=np.int64)
    symbols[text_at[which] + k] = np.unique(prints, return_inverse=True)[1] + 2
    symbols[-1] = 0
    order = suffix_array(symbols)
    # suffixes that begin with ``core`` whole blocks, in their order; neighbours with equal ones share a class
    room = np.zeros(len(symbols), dtype=np.int64)
    room[text_at[which] + k] = blocks[which] - k
    full = order[room[order] >= core]
    same = np.zeros(len(full), dtype=bool)
    same[1:] = True
    for j in range(core):
        same[1:] &= symbols[full[1:] + j] == symbols[full[:-1] + j]
    classes = np.zeros(len(symbols), dtype=np.int64)
    classes[full] = np.cumsum(~same)
    i, at, before = _spans(ahead, owned, block)
    start = base[i] + at
    at_core = start + before
    number = classes[text_at[i] + (at + before - first[i]) // block]
    stop = at_core + core * block
    key = mix(mix(number.astype(np.uint64) * np.uint64(1024) + before.astype(np.uint64)) ^ running.of(start, at_core))
    key = mix(key ^ mix(running.of(stop, start + length) + _RATIO))
    _, place = np.unique(key, return_inverse=True)
    hit = np.bincount(place, weights=occurs[i])[place] >= 2
    return np.split(hit, np.cumsum(owned)[:-1])


def _by_suffixes(found: DataFrame, length: int, block: int) -> DataFrame:
    """h, c and a byte mask of repeated strings, for contexts that occur once."""

    def solve(rows: list) -> pd.DataFrame:
        owned, ahead = np.array([r.owned for r in rows]), np.array([r.ahead for r in rows])
        hits = repeated_in_groups(np.array([r.h for r in rows]), np.array([r.n for r in rows]), owned, ahead, [r.raw for r in rows], length, block)
        out = [(r.h, r.c, np.packbits(hit).tobytes()) for r, hit in zip(rows, hits, strict=True) if r.n == 1 and hit.any()]
        return pd.DataFrame(out, columns=["h", "c", "mask"])

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for b in batches:
            for r in b.itertuples(index=False):
                if len(held) >= 3000 and held[-1].h != r.h:
                    yield solve(held)
                    held = []
                if held and held[-1].h == r.h and held[-1].c == r.c:
                    continue
                held.append(r)
        if held:
            yield solve(held)

    grouped = found.repartition("h").sortWithinPartitions("h", "c")  # at most GROUP contexts for each h
    return grouped.select("h", "c", "n", "owned", "ahead", "raw").mapInPandas(tasks, "h long, c long, mask binary")


def _by_counts(found: DataFrame, length: int, block: int) -> DataFrame:
    """The same for anchor values with many contexts, by counts of cores and then of strings."""
    width = length // block * block - block

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                i, at, before = _spans(np.array([r.ahead]), np.array([r.owned]), block)
                running = Running(np.frombuffer(r.raw, dtype=np.uint8))
                cells = np.unique(at + before)
                k = mix(running.of(cells, cells + width) ^ mix(np.array([r.h]).view(np.uint64)))
                low, high = np.searchsorted(at + before, cells, "left"), np.searchsorted(at + before, cells, "right") - 1
                whole = mix(running.of(at[low], at[high] + length) ^ mix(((cells - at[low]) * 1024 + (high - low)).astype(np.uint64)))
                yield pd.DataFrame({"k": k.view(np.int64), "w": whole.view(np.int64), "h": r.h, "c": r.c, "low": at[low], "many": high - low + 1, "n": r.n})

    cells = written(found.select("h", "c", "n", "owned", "ahead", "raw").mapInPandas(cores, "k long, w long, h long, c long, low int, many int, n long"), "cores")
    counts = cells.groupBy("k", "w").agg(F.sum("n").alias("whole"))
    several = counts.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("whole").alias("total"))
    # all strings of a whole cell that occurs twice are repeated; a core that occurs once has none
    sure = cells.join(counts.filter("whole > 1").select("k", "w"), ["k", "w"]).filter("n = 1").select("h", "c", "low", "many")
    unsure = cells.join(several.filter("kinds > 1 AND total > 1").select("k"), "k", "left_semi").select("h", "c", "low", "many")
    todo = unsure.groupBy("h", "c").agg(F.collect_list(F.struct("low", "many")).alias("cells"))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                at = np.concatenate([np.arange(x["low"], x["low"] + x["many"]) for x in r.cells])
                key = mix(Running(np.frombuffer(r.raw, dtype=np.uint8)).of(at, at + length))
                yield pd.DataFrame({"s": key.view(np.int64), "h": r.h, "c": r.c, "low": at, "n": r.n})

    each = written(found.join(todo, ["h", "c"]).select("h", "c", "n", "raw", "cells").mapInPandas(strings, "s long, h long, c long, low int, n long"), "strings")
    twice = each.groupBy("s").agg(F.sum("n").alias("n")).filter("n > 1").select("s")
    hits = each.join(twice, "s", "left_semi").filter("n = 1").select("h", "c", "low", F.lit(1).alias("many"))
    both = sure.unionByName(hits).groupBy("h", "c").agg(F.collect_list(F.struct("low", "many")).alias("parts"))

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, c, parts in zip(b["h"], b["c"], b["parts"], strict=True):
                mask = np.zeros(max(p["low"] + p["many"] for p in parts), dtype=bool)
                for p in parts:
                    mask[p["low"] : p["low"] + p["many"]] = True
                out.append((h, c, np.packbits(mask).tobytes()))
            yield pd.DataFrame(out, columns=["h", "c", "mask"])

    return both.mapInPandas(masks, "h long, c long, mask binary")


def repeated_places(
    docs: DataFrame, length: int = LENGTH, slack: int = SLACK, block: int = BLOCK, group: int = GROUP, scratch: list[DataFrame] | None = None
) -> DataFrame:
    """doc, th and, for every context with repeated strings, its starts, how many strings it owns, and their mask (null: all).

    ``scratch`` gets the tables that are of no use once the result is written.
    """
    places = written(_places(docs, length, slack), "contexts-of-texts")
    here = F.struct("doc", "th", F.col("starts")[0].alias("start"), "owned", "ahead")
    kinds = written(places.groupBy("h", "c").agg(F.sum(F.size("starts")).alias("n"), F.min(here).alias("at")), "context-counts")
    anchors = kinds.groupBy("h").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 AND least = 1").select("h", "size")
    anchors = written(anchors, "anchors")
    # most anchor values have one context: they, and the places of contexts without repeats, are told before they are shuffled
    wanted = may_match(kinds, F.col("h"), anchors, "h").filter("maybe").join(anchors, "h").select("h", "c", "n", "size", "at.*")
    found = _texts_of(docs, wanted, length)
    masks = _by_suffixes(found.filter(F.col("size") <= group), length, block).unionByName(_by_counts(found.filter(F.col("size") > group), length, block))
    if scratch is not None:
        scratch += [places, kinds, found]
    every = kinds.filter("n > 1").select("h", "c", F.lit(None).cast("binary").alias("mask"))
    hit = written(every.unionByName(masks), "masks")
    near = may_match(places, _both("h", "c"), hit.select(_both("h", "c").alias("k")), "k").filter("maybe")
    return near.join(hit, ["h", "c"]).select("doc", "th", "starts", "owned", "mask")


def _covered(n: int, parts, length: int) -> np.ndarray:
    """Bytes of a text of ``n`` bytes that repeated strings cover."""
    steps = np.zeros(n + 1, dtype=np.int32)
    for p in parts:
        at = np.arange(p["owned"])
        if p["mask"] is not None:
            hit = np.unpackbits(np.frombuffer(p["mask"], dtype=np.uint8))[: p["owned"]]
            at = np.flatnonzero(hit)
        for start in p["starts"]:
            np.add.at(steps, start + at, 1)
            np.add.at(steps, start + at + length, -1)
    return np.cumsum(steps[:n]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, slack: int = SLACK, block: int = BLOCK, group: int = GROUP, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The carried columns (all but the text by default), and kept, n_bytes, n_removed, n_spans.

    ``kept`` holds the bytes left; with ``as_text`` they are a string, without the rest of characters that a cut splits.
    """
    carried = [x for x in docs.columns if x != "text"] if carry is None else carry
    scratch: list[DataFrame] = []
    parts = repeated_places(docs.select("doc_id", "text"), length, slack, block, group, scratch)
    by_doc = parts.groupBy("doc", "th").agg(F.collect_list(F.struct("starts", "owned", "mask")).alias("_parts"))  # bounded by the text's own length
    by_doc = written(by_doc.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "_parts"), "parts")
    for table in scratch:
        release(table)
    doc, th = _key()
    row = F.struct(*[docs[f"`{x}`"] for x in carried]).alias("_row")
    every = docs.select(row, doc.alias("_doc"), th.alias("_th"), docs["text"].alias("_text"))
    # texts without repeats, mostly nearly all, meet no shuffle
    every = may_match(every, _both("_doc", "_th"), by_doc.select(_both("_doc", "_th").alias("k")), "k")
    read = every.filter("maybe").drop("maybe").join(by_doc, ["_doc", "_th"], "left")
    text, none = F.coalesce("_text", F.lit("")), F.lit(0).cast("long")
    whole = every.filter("NOT maybe").select(
        "_row", (text if as_text else F.encode(text, "UTF-8")).alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans")
    )
    fields = read.schema["_row"].dataType

    @tidy
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found in zip(b["_text"], b["_parts"], strict=True):
                raw = _bytes(text)
                gone = _covered(len(raw), found if found is not None else [], length)
                spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1]).sum())
                left = raw[~gone].tobytes()
                out.append((left.decode(errors="ignore") if as_text else left, len(raw), int(gone.sum()), spans))
            made = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])
            made.insert(0, "_row", b["_row"].to_numpy() if len(carried) else [{}] * len(b))
            yield made

    made = read.select("_row", "_text", "_parts").mapInPandas(cut, f"_row {fields.simpleString()}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    return made.unionByName(whole).select(*[F.col("_row")[x].alias(x) for x in carried], "kept", "n_bytes", "n_removed", "n_spans")


def cut_repeats(docs: DataFrame, length: int = LENGTH, slack: int = SLACK, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with what repeats cut from ``text``, null for null; ``n_chars``, where there is one, follows it."""
    given = F.struct(*[docs[f"`{x}`"] for x in docs.columns if x != "text"])
    row = docs.select(F.struct(given.alias("given"), docs["text"].isNull().alias("missing")).alias("row"), docs["doc_id"], docs["text"])
    made = without_repeats(row, length, slack, block, carry=["row"], as_text=True)
    missing, old = F.col("row")["missing"], F.col("row")["given"]
    columns = {"text": F.when(~missing, F.col("kept"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(missing, old["n_chars"]).otherwise(F.length("kept"))
    return made.select(*[(columns[x] if x in columns else old[x]).cast(docs.schema[x].dataType).alias(x) for x in docs.columns])
