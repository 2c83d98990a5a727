"""Helpers of the corpus operators: the shared folder, written tables, words, input columns."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rules of the operators use it
WS = " \t\n\x0b\x0c\r"

WORD = re.compile(r"[^\W_]+")


#: bits of the filters that spare rows without a partner a shuffle
FILTER_BITS = 23


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, in local mode else one inside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    Cuts the lineage for results that a plan reads several times; the table survives lost executors. The folder
    belongs to the session's scratch area and is left to its retention rule.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Give back the space of a ``written`` table that nothing reads any more: all that was made of it is written too."""
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose memory goes back to the system at the end of the task.

    Spark keeps its Python workers for later tasks, and the allocators keep what the largest task took: 300 MB with long texts.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return wrapped


def may_match(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``maybe`` that is false only where the long ``key`` is not in the column ``name`` of ``keys``.

    A Bloom filter of fixed size: a table of at most 2^FILTER_BITS / 64 numbers, which is therefore broadcast, whatever the
    number of keys. With very many keys it lets more rows through, never fewer.
    """
    size = 1 << FILTER_BITS
    spots = lambda k: (F.pmod(F.xxhash64(k), F.lit(size)), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(size)))
    bits = keys.select(F.explode(F.array(*spots(F.col(name)))).alias("spot"))
    bits = bits.select(F.floor(F.col("spot") / 64).alias("at"), F.expr("shiftleft(1L, CAST(spot % 64 AS INT))").alias("bit"))
    held = written(bits.groupBy("at").agg(F.bit_or("bit").alias("bits")), "filter")
    out = rows.withColumns(dict(zip(("_s0", "_s1"), spots(key), strict=True)))
    for i in (0, 1):
        side = F.broadcast(held.select(F.col("at").alias(f"_a{i}"), F.col("bits").alias(f"_b{i}")))
        out = out.join(side, F.floor(F.col(f"_s{i}") / 64) == F.col(f"_a{i}"), "left")
    set_ = [F.expr(f"shiftright(_b{i}, CAST(_s{i} % 64 AS INT)) & 1 = 1") for i in (0, 1)]
    return out.select(*rows.columns, F.coalesce(set_[0] & set_[1], F.lit(False)).alias("maybe"))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def normal_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; a null text has none."""
    return WORD.findall(text.lower()) if text else []
