"""Small building blocks shared by every operator.

Whitespace means ASCII whitespace throughout; lengths count code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def squash_ws(col: Column) -> Column:
    # nothing but single blanks is left to trim
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def round_half_up(col: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(col.cast("double") + F.lit(0.5))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, null when there is none."""
    found = F.regexp_extract(col, pattern, group)
    return F.when(col.rlike(pattern), found)


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """True when any literal occurs in ``col``; one compiled alternation."""
    escaped = "|".join(_escape(w) for w in words)
    return col.rlike(escaped)


def _escape(word: str) -> str:
    special = set(".^$*+?()[]{}|\\/-")
    return "".join("\\" + ch if ch in special else ch for ch in word)


def str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def map_lookup(key: Column, table: dict) -> Column:
    """Constant dictionary lookup that stays in the projection."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """The first row of every key by ``order``.

    An aggregate, so each task pre-reduces its rows before the shuffle; a key
    that holds a third of the table still sends one row per task.
    """
    keep = list(keep) if keep is not None else [x for x in df.columns if x not in keys]
    best = F.min_by(F.struct(*[F.col(x) for x in keep]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[x].alias(x) for x in keep])


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: Sequence[str],
    salts: int = 64,
    rank: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of every key, exact under skew.

    Rows are ranked inside (key, salt) first, so a hot key is spread over
    ``salts`` tasks and at most ``salts * k`` of its rows reach the final
    ranking.
    """
    spread = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        .withColumn("_pre", F.row_number().over(spread))
        .filter(F.col("_pre") <= k)
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= k)
        .drop("_salt", "_pre")
    )


def by_shuffle(df: DataFrame) -> DataFrame:
    """The same rows, never as a broadcast side of a join.

    The planner takes a table's size from its compressed files, and that of exploded or nested rows from the rows they are
    made of; what grows with the input would so come to the driver whole.
    """
    return df.hint("merge")


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi join whose hottest key is split into ``salts`` parts.

    For a per-site or per-file side joined to per-page rows: the small side is
    copied to every salt, each big row belongs to one, chosen by the hash of
    ``spread_by`` so that a repeated task places rows the same way.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, in local mode else below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, for a result that a plan reads several times."""
    path = shared_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same rows stored once in the shared folder in buckets of ``key``: a join on it moves its other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    # dealt the same way before, so that every bucket is one file
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", shared_folder(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def number_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based position of every row in ascending order of a unique key.

    Rows are range-partitioned and numbered inside each partition; the rows of the partitions before are added. The
    number of partitions follows the session and the table, and only one row for each meets in a window.
    """
    placed = settled(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    # one row per partition, so this broadcast is bounded by their number
    return placed.join(F.broadcast(before), "_part").withColumn(name, local + F.col("_before")).drop("_part", "_before")


def _running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], fold: Callable[[Column], Column],
    both: Callable[[Column, Column], Column],
) -> DataFrame:
    """``fold`` of each value over the rows of the same key up to this one, exact and even under skew.

    Rows are range-partitioned by (keys, order), so a key of any size is spread over as many partitions as it fills. Folds
    run inside (partition, key); a key that goes on from one partition to the next gets what the partitions before hold.
    A boundary between partitions lies in one key at most, so that is less than two rows for each partition.
    Nulls of a key are equal and come first. The rows are written once to the shared folder.
    """
    marked = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    placed = settled(marked.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    spans = ends.withColumn("_prev", F.lag("_hi").over(Window.orderBy("_part"))).filter("_lo <=> _prev").select(F.col("_lo").alias("_key")).distinct()
    # one row per boundary at most: the broadcasts are bounded by the number of partitions
    marks = F.broadcast(spans.select(*[F.col("_key")[k].alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    sums = placed.join(marks, same).groupBy("_part", *[f"_k{i}" for i in range(len(keys))]).agg(*[fold(F.col(f"_v_{n}")).alias(f"_s_{n}") for n in values])
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("_part").alias("_p"), *[f"_k{i}" for i in range(len(keys))], *[fold(F.col(f"_s_{n}")).over(earlier).alias(f"_c_{n}") for n in values])
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({f"_l_{n}": fold(F.col(f"_v_{n}")).over(upto) for n in values})
    joined = local.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & same, "left")
    return joined.select(*df.columns, *[both(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **values: Column) -> DataFrame:
    """Adds the sum of each of ``values`` over the rows of the same key up to this one."""
    return _running(df, keys, order, values, F.sum, lambda here, before: here + F.coalesce(before, F.lit(0)))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **values: Column) -> DataFrame:
    """Adds the greatest of each of ``values`` over the rows of the same key up to this one; nulls do not count.

    With values that start with the order itself this is the last one before each row, as an as-of join needs it.
    """
    return _running(df, keys, order, values, F.max, lambda here, before: F.greatest(here, before))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row within its key by ``order``; a key with a third of all rows meets no single task."""
    return running_totals(df, keys, order, **{name: F.lit(1).cast("long")})
