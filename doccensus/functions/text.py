"""Structure measures of markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccensus.functions import urls as U
from doccensus.functions.common import c, count_matches, extract_all, round_half_up, trim_ws


def words(col: Column) -> Column:
    return count_matches(col, r"\S+")


def _zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0)).cast("long")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(values) > 0, round_half_up(total / F.size(values))).otherwise(F.lit(0).cast("long"))


def structural_signals(md: Column | str, title: Column | str, url: Column | str) -> dict[str, Column]:
    """The twenty structure measures, keyed by column name.

    Fences open and close, so the number of code blocks is half the fence count.
    """
    m = c(md)
    levels = F.transform(extract_all(m, r"(?m)^(#{1,6})\s+[^\n]+$"), lambda h: F.length(h))
    used = F.array_sort(F.array_distinct(levels))
    later = F.slice(used, F.lit(2), F.greatest(F.size(used), F.lit(1)))
    ordered = F.forall(F.zip_with(used, later, lambda a, b: F.coalesce(b - a <= 1, F.lit(True))), lambda ok: ok)

    sections = F.filter(F.split(m, r"(?m)^#{1,6}\s+"), lambda s: trim_ws(s) != "")
    section_words = F.transform(sections, lambda s: words(s))

    no_code = F.regexp_replace(m, r"(?s)```.*?```", "")
    blocks = F.transform(F.split(no_code, r"\n\s*\n"), lambda p: trim_ws(p))
    paragraphs = F.filter(
        blocks, lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("|") & ~p.rlike(r"^[-*+]\s|^\d+\.\s")
    )
    paragraph_words = F.transform(paragraphs, lambda p: words(p))
    items = count_matches(no_code, r"(?m)^\s*[-*+]\s|^\s*\d+\.\s")
    rows = count_matches(no_code, r"(?m)^\|[^\n]+\|$")
    tables = F.when(rows > 0, F.greatest(F.lit(1), F.floor(rows / 3))).otherwise(0).cast("long")
    total = F.size(paragraphs) + items + tables

    targets = extract_all(m, r"\[[^\]]*\]\(([^)]+)\)")
    own = U.host(url)
    internal = lambda h: h.startswith("#") | h.startswith("/") | ((own != "") & h.contains(own))
    first_heading = F.lower(F.coalesce(F.get(extract_all(m, r"(?m)^#{1,6}\s+([^\n]+)$"), F.lit(0)), F.lit("")))
    lead = F.lower(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit("")))
    title_words = F.filter(F.split(F.lower(c(title)), r"\s+"), lambda w: F.length(w) > 3)

    return {
        "heading_count": F.size(levels).cast("long"),
        "max_heading_depth": _zero_if_null(F.array_max(levels)),
        "heading_levels_valid": ordered,
        "section_count": F.size(sections).cast("long"),
        "avg_section_words": _mean(section_words),
        "max_section_words": _zero_if_null(F.array_max(section_words)),
        "paragraph_count": F.size(paragraphs).cast("long"),
        "list_item_count": items,
        "table_count": tables,
        "structure_ratio": F.when(total > 0, (items + tables) / total).otherwise(F.lit(0.0)),
        "code_block_count": F.floor(count_matches(m, "```") / 2).cast("long"),
        "tagged_code_blocks": count_matches(m, r"```\w+"),
        "internal_links": F.size(F.filter(targets, internal)).cast("long"),
        "external_links": F.size(F.filter(targets, lambda h: ~internal(h) & h.startswith("http"))).cast("long"),
        "has_tldr": first_heading.rlike("summary|overview|tl;?dr|introduction|at a glance|quick start"),
        "front_loaded": F.exists(title_words, lambda w: lead.contains(w)),
        "avg_paragraph_words": _mean(paragraph_words),
        "long_paragraphs": F.size(F.filter(paragraph_words, lambda n: n > 150)).cast("long"),
        "defined_terms": count_matches(m, r"\*\*[^*]+\*\*\s*[:–—]"),
        "total_words": words(m),
    }
