"""Text going to and coming from language models; the calls themselves are outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus import constants as K
from doccensus.functions.common import c, extract, trim_ws

# Longest input per request kind
INPUT_CHARS = {"summary": 12000, "dimension": 50000, "fix": 25000, "doc": 8000, "issue": 3000}


def json_text(text: Column | str, array: bool = False) -> Column:
    """The JSON part of an answer: fenced block, whole text, else the outermost braces.

    Null when no part parses.
    """
    t = trim_ws(c(text))
    fenced = trim_ws(extract(t, r"(?s)```(?:json)?\s*(.*?)```"))
    loose = extract(t, r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})")
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.when(fenced.isNotNull(), valid(fenced)).otherwise(F.coalesce(valid(t), valid(loose)))


def parse_model_json(text: Column | str, schema: str) -> Column:
    return F.from_json(json_text(text, schema.lower().startswith("array")), schema)


def summary_fields(text: Column | str, title: Column | str) -> dict[str, Column]:
    """Labelled lines of a page summary with their defaults."""
    t, name = c(text), c(title)
    line = lambda label: F.nullif(trim_ws(extract(t, rf"(?m)^{label}:\s*([^\n]+)$")), F.lit(""))
    kind = F.lower(line("DOC TYPE"))
    terms = F.coalesce(line("KEY TERMS"), name)
    section = F.coalesce(extract(t, r"(?m)^COVERS:\n((?:[-*]\s*[^\n]+\n?)*)"), F.lit(""))
    covers = F.filter(
        F.transform(F.split(section, "\n"), lambda x: trim_ws(F.regexp_replace(x, r"^[-*]\s*", ""))), lambda x: x != ""
    )
    return {
        "documentation_type": F.when(kind.isin(K.SUMMARY_DOC_TYPES), kind),
        "topic": F.coalesce(line("TOPIC"), F.concat(F.lit("Documentation page: "), name)),
        "key_terms": F.filter(F.transform(F.split(terms, ","), trim_ws), lambda x: x != ""),
        "covers": F.when(F.size(covers) > 0, covers).otherwise(F.array(F.concat(F.lit("Content about "), name))),
        "code_examples": F.coalesce(line("CODE EXAMPLES"), F.lit("None")),
        "limitations": F.coalesce(line("LIMITATIONS"), F.lit("None noted")),
    }


def model_requests(rows: DataFrame, answered: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """Rows still without an answer, their input cut to the kind's length."""
    return rows.join(answered.select(key), key, "left_anti").select(key, F.lit(kind).alias("kind"), F.substring(text, 1, INPUT_CHARS[kind]).alias("input"))
