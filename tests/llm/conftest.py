import pytest

#: rows that every operator must bear: nulls in any column, empty and very long texts, ties, repeated rows
_LONG = " ".join(f"Word{i % 977} of the long text, {i}." for i in range(30_000))
_PROSE = "The house of the old man stood at the end of the road and it was as it is on this day. " * 4
ROWS = [
    (1, _PROSE, "en", "a", 1), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, _LONG, None, "a", 5),
    (None, "A text without an id, which is kept as it is.", "en", "a", 3), (6, _PROSE, "en", "a", 1), (6, _PROSE, "en", "a", 1),
    (7, "   \n\t ", "xx", "a", 5), (8, "é" * 1500, "fr", "a", 1500), (9, "###\n###\n###", "de", "b", 11),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
CLASHING = [
    "_row", "key", "print", "node", "verdict", "h", "kept", "_text", "words", "class_id", "_null", "_gone", "_id", "_hash", "_doc", "_th", "_parts", "_of",
    "_same", "_c", "_w", "_at", "row", "at", "given", "missing", "a", "b", "text_hash", "k",
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
