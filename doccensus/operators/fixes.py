"""Proposed text fixes and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import c, round_half_up, trim_ws


def issues_to_fix(findings: DataFrame, actions: DataFrame, selected: DataFrame) -> DataFrame:
    """Distinct texts to fix per page: the selected ones, else findings and actions."""
    chosen = selected.select("page", F.col("text")).distinct()
    every = findings.select("page", F.col("finding").alias("text")).unionByName(actions.select("page", F.col("action").alias("text")))
    rest = every.join(chosen.select("page").distinct(), "page", "left_anti")
    # texts repeat so much that shuffled bytes, by which small partitions are joined, say little of the rows in them
    parts = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), every.rdd.getNumPartitions())
    return chosen.unionByName(rest.repartition(parts, "page").distinct())


def _quoted(words: Column, between: str) -> Column:
    """A pattern of the literal words with ``between`` in the gaps."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), between)


def _found(text: Column, original: Column) -> Column:
    """(hit, strategy) of the first text that a fix may replace; null hit when there is none or the fix names no text."""
    words = F.filter(F.split(trim_ws(original), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 2)
    spaced = F.when(F.size(words) > 0, F.regexp_substr(text, _quoted(words, r"\s+")))
    loose = F.when(F.size(long) > 2, F.regexp_substr(text, F.concat(F.lit("(?s)"), _quoted(long, ".{0,50}?"))))
    pick = lambda hit, name: F.struct(hit.alias("hit"), F.lit(name).alias("strategy"))
    return (
        F.when(text.contains(original), pick(original, "exact"))
        .when(spaced.isNotNull(), pick(spaced, "whitespace"))
        .when(loose.isNotNull(), pick(loose, "tokens"))
    )


def apply_fixes(docs: DataFrame, fixes: DataFrame, selected_ids: DataFrame | None = None) -> DataFrame:
    """Apply each document's fixes in order; every fix sees the text left by the one before.

    Strategies: exact text, same words with other whitespace, then the long
    tokens with up to 50 characters between them; the first occurrence only.
    A document meets its own short list of fixes by an equi join, and one fold
    over that list does the rest in the row, so documents never gather.
    Replacements are literal; a fix without a text to replace is not applied,
    one without a replacement removes the text.
    """
    wanted = fixes if selected_ids is None else fixes.join(selected_ids, "fix_id", "left_semi")
    todo = wanted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "fix_id", "original", "proposed"))).alias("todo"))
    outcome = "array<struct<fix_id:string,applied:boolean,strategy:string>>"
    start = F.struct(F.coalesce("content", F.lit("")).alias("content"), F.array().cast(outcome).alias("outcomes"))

    def step(state: Column, fix: Column) -> Column:
        done = lambda place: F.struct(
            F.when(place.isNull(), state["content"]).otherwise(splice(state["content"], place["hit"], F.coalesce(fix["proposed"], F.lit("")))).alias("content"),
            F.concat(state["outcomes"], F.array(F.struct(fix["fix_id"].alias("fix_id"), place.isNotNull().alias("applied"), place["strategy"].alias("strategy")))).cast(outcome).alias("outcomes"),
        )
        return F.element_at(F.transform(F.array(_found(state["content"], fix["original"])), done), 1)

    joined = docs.select("doc_id", "content").join(todo, "doc_id")
    return joined.select("doc_id", F.aggregate("todo", start, step).alias("r")).select("doc_id", "r.content", "r.outcomes")


def apply_exact_fixes(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """The exact strategy alone, as one built-in fold over a document's fixes."""
    todo = fixes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "original", "proposed"))).alias("todo"))
    folded = F.aggregate("todo", F.col("content"), lambda text, f: splice(text, f["original"], f["proposed"]))
    return docs.select("doc_id", "content").join(todo, "doc_id").select("doc_id", folded.alias("content"))


def splice(text: Column, old: Column, new: Column) -> Column:
    """Literal replacement of the first occurrence."""
    at = F.instr(text, old)
    cut = F.concat(
        F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))
    )
    return F.when(at > 0, cut).otherwise(text)


def _splice_match(text: Column, pattern: str, new: Column) -> Column:
    return splice(text, F.regexp_extract(text, pattern, 0), new)


def add_changelog(docs: DataFrame, applied: DataFrame, date: Column) -> DataFrame:
    """Record the applied fixes in the document's changelog section.

    After an existing heading, else before the support section, else at the end.
    ``applied`` (doc_id, pos, category, rationale).
    """
    lines = applied.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "category", "rationale"))).alias("a")
    )
    text = F.array_join(F.transform("a", lambda x: F.concat(F.lit("  - "), x["category"], F.lit(": "), x["rationale"])), "\n")
    j = docs.join(lines, "doc_id")
    entry = F.concat(F.lit("\n### ["), date, F.lit("] - AI Update\n- "), F.size("a"), F.lit(" fixes applied:\n"), text, F.lit("\n"))
    body = F.col("content")
    head = F.concat(F.lit("## Changelog\n"), entry)
    return j.select(
        "doc_id",
        F.when(body.rlike(r"(?i)##\s+Changelog"), _splice_match(body, r"(?i)##\s+Changelog", head))
        .when(body.rlike(r"(?i)##\s+Support"), _splice_match(body, r"(?i)##\s+Support", F.concat(head, F.lit("\n---\n\n## Support"))))
        .otherwise(F.concat(body, F.lit("\n\n---\n\n"), head))
        .alias("content"),
    )


def fix_summary(fixes: DataFrame) -> DataFrame:
    """Fix counts by category and the mean confidence per session."""
    return fixes.groupBy("session_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("category") == x).alias(x.lower()) for x in K.FIX_CATEGORIES],
        F.coalesce(round_half_up(F.avg("confidence")), F.lit(0)).alias("mean_confidence"),
    )


def patch_file(content: Column | str, original: Column | str, corrected: Column | str) -> Column:
    """Replace the first exact occurrence, else append, else start the file."""
    file, old, new = F.coalesce(c(content), F.lit("")), F.coalesce(c(original), F.lit("")), c(corrected)
    return (
        F.when((old != "") & file.contains(old), splice(file, old, new))
        .when(file != "", F.concat(file, F.lit("\n\n"), new))
        .otherwise(new)
    )
