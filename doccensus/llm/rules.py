"""Quality rules by distribution divergence; DataFrame functions only.

Words are maximal runs of characters other than ASCII white space. A document fails the base rules when it has
fewer than ``MIN_WORDS`` words or when more than half of them stand in 3-word windows that occur twice or more in it
(windows are compared by a 64-bit hash). Otherwise its histograms are held against those of its language: the mean
distribution over all distinct texts with the same ``lang`` that pass the base rules, of the table at hand, where
languages that are not in ``LANGUAGES``, and null, share one reference. Copies and junk thus do not move it. It is rejected when the Jensen-Shannon distance (base 2) of the
character classes or of the common words is over its limit; a histogram with fewer observations than its guard is
not judged.

Defined cases: a null or empty text has no words and fails; repeated rows are judged alike and each kept or not;
an empty table gives no rows; further columns stay as they are, also those with names that the rules use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.llm.shared import WS, let, written

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: limits of the Jensen-Shannon distance, and the observations a histogram needs to be judged
MAX_CHAR_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_COMMON = 0.5, 50
_SCALE = 1_000_000

# Character classes, counted in this order; the rest is a class of its own
CHAR_CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", r".,;:!?'\"()-"]
# The most frequent function words of each language
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on by this are from at be or".split(),
    "de": "der die und das von zu mit den ist ein nicht dem im auf eine als auch des sich".split(),
    "fr": "le la les de des et un une en que qui dans du pour est sur pas par ou".split(),
    "es": "el la los las de que y en un una por con del se al su es lo como".split(),
}
LANGUAGES = list(COMMON_WORDS)
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first one included."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.when(b - a < 3, b - a).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def same(order: Column) -> Column:
        hit = F.filter(
            F.sequence(F.lit(0), F.size(order) - 1),
            lambda k: (F.get(order, k)["h"] == F.get(order, k - 1)["h"]) | (F.get(order, k)["h"] == F.get(order, k + 1)["h"]),
        )
        places = F.array_sort(F.transform(hit, lambda k: F.get(order, k)["i"]))
        return F.when(F.size(hit) == 0, 0).otherwise(let(places, covered))

    def windows(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(order, same))

    hashes = F.transform(
        F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c")),
        lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
    )
    # the last two entries of the zip are no full windows
    return F.when(F.size(words) < 3, 0).otherwise(let(F.slice(hashes, 1, F.size(words) - 2), windows)).cast("long")


def base_columns(text: Column, words: Column, rest: Column) -> dict[str, Column]:
    """The base counts; ``rest`` is the text without lower-case letters, which no count but that of words needs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(rest, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(rest, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def without_lower(text: Column) -> Column:
    return F.regexp_replace(text, f"[{CHAR_CLASSES[0]}]+", "")


def char_histogram(text: Column, rest: Column) -> Column:
    """Counts of each character class and of what is left; all but the first come from the text without that class."""
    each = [F.length(rest) - F.length(F.regexp_replace(rest, f"[{c}]+", "")) for c in CHAR_CLASSES[1:]]
    others = F.length(F.regexp_replace(rest, f"[{''.join(CHAR_CLASSES)}]+", ""))
    return F.array(F.length(text) - F.length(rest), *each, others)


def word_histogram(text: Column) -> Column:
    """Counts of each common word among the runs of letters, and of all other runs."""

    def count(runs: Column) -> Column:
        # a split leaves an empty entry before the first and after the last separator
        empty = F.when(F.element_at(runs, 1) == "", 1).otherwise(0) + F.when((F.size(runs) > 1) & (F.element_at(runs, -1) == ""), 1).otherwise(0)

        def each(common: Column) -> Column:
            return F.array(*[F.size(common) - F.size(F.array_remove(common, w)) for w in WORDS], F.size(runs) - empty - F.size(common))

        return let(F.filter(runs, lambda w: w.isin(WORDS)), each)

    return let(F.split(F.lower(text), r"\P{L}+"), count)


def _total(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)


def language_references(counted: DataFrame) -> DataFrame:
    """Mean distributions over the rows of ``counted``: one row per language of ``LANGUAGES`` and one for the rest."""

    def shares(histogram: Column) -> Column:
        total = _total(histogram)
        return let(total, lambda n: F.transform(histogram, lambda x: F.when(n > 0, F.floor(x.cast("long") * _SCALE / n)).otherwise(0)))

    parts = counted.select(F.col("_of"), shares(F.col("_c")).alias("c"), shares(F.col("_w")).alias("w"))
    sums = parts.groupBy("_of").agg(
        *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES) + 1)], *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    )
    return sums.select(
        F.col("_of").alias("_language"),
        F.array(*[f"c{i}" for i in range(len(CHAR_CLASSES) + 1)]).alias("_chars"),
        F.array(*[f"w{i}" for i in range(len(WORDS) + 1)]).alias("_common"),
    )


def _language(docs: DataFrame) -> Column:
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    return F.when(lang.isin(LANGUAGES), lang).otherwise("other")


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms; null when one is empty."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def both(na: Column, nb: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: term(x / na, y / nb) + term(y / nb, x / na))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))

    return F.when((_total(a) > 0) & (_total(b) > 0), let(F.struct(_total(a).alias("a"), _total(b).alias("b")), lambda n: both(n["a"], n["b"])))


def histograms(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) as a struct ``_row``, the base counts, the language and both histograms."""
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)]).alias("_row")
    text = F.coalesce(docs["text"], F.lit(""))
    read = docs.select(row, text.alias("_text"), words_of(text).alias("_words"), without_lower(text).alias("_rest"), _language(docs).alias("_of"))
    t, rest = F.col("_text"), F.col("_rest")
    return read.select(
        "_row", "_of", F.md5(t).alias("_same"), *[c.alias(n) for n, c in base_columns(t, F.col("_words"), rest).items()],
        char_histogram(t, rest).alias("_c"), word_histogram(t).alias("_w"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all by default) as ``_row`` and a struct ``verdict``: counts, distances, kept.

    The texts are counted once; counts and carried columns are written to the shared folder, since the references need
    all documents before any can be judged. A language without a text that passes the base rules has no reference, and
    its texts fail by these rules.
    """
    counted = written(histograms(docs, carry), "histograms")
    # equal texts of a language have equal histograms
    sound = counted.filter(~_base_failed()).groupBy("_of", "_same").agg(F.first("_c").alias("_c"), F.first("_w").alias("_w"))
    references = language_references(sound)
    # at most one row per language of LANGUAGES and one more, so this broadcast has a fixed bound
    held = counted.join(F.broadcast(references), F.col("_of") == F.col("_language"), "left").select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _base_failed().alias("base_failed"),
        F.when(_total(F.col("_c")) >= MIN_CHARS, distance(F.col("_c"), F.col("_chars"))).alias("char_distance"),
        F.when(_total(F.col("_w")) >= MIN_COMMON, distance(F.col("_w"), F.col("_common"))).alias("word_distance"),
    )
    fits = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance"]
    # one expression over both sides of the join, so that a filter on it is not taken apart and worked out twice
    verdict = F.struct(*names, F.coalesce(~F.col("base_failed") & fits, F.lit(False)).alias("kept")).alias("verdict")
    return held.select("_row", verdict)


def judged_columns(judged: DataFrame, *keys: str) -> DataFrame:
    return judged.select(*[F.col("_row")[k].alias(k) for k in keys], "verdict.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return judge(docs).filter("verdict.kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
