"""Sums along a linked list that is spread over the cluster.

An element is named by two longs (c, at) and names its successor (nc, nat); the last one has nat = -1. ``suffix_sums``
gives every element the sums of the weights from it to the end of the list.

How it runs: elements are range-partitioned by name. Inside blocks of at most ``BLOCK`` elements, successors that lie in the
same block are followed by pointer jumping in numpy, so a block turns into as many chains as the list enters it from
outside. Only the chains' first elements are left to jump over the cluster: each round doubles how far every chain
reaches, with one join on narrow rows, and is written to the shared folder, so a lost executor costs its own tasks. Any
placing of the elements gives the same sums; names near each other in the list make the chains long and the rounds few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccensus.llm.shared import written

#: elements that are followed together in a task's memory
BLOCK = 1 << 18
#: rounds double the reach, so this many pass any list that fits a cluster
MAX_ROUNDS = 64


def jump(after: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the sums to the last one reached by ``after`` (an index, -1 for none), and that one's index."""
    sums, last, ahead = sums.copy(), np.arange(len(after)), after.copy()
    for _ in range(MAX_ROUNDS):
        live = np.flatnonzero(ahead >= 0)
        if not len(live):
            return sums, last
        to = ahead[live]
        sums[live] += sums[to]
        last[live] = last[to]
        ahead[live] = ahead[to]
    raise ValueError("the list has a cycle")


def _successors(c: np.ndarray, at: np.ndarray, nc: np.ndarray, nat: np.ndarray) -> np.ndarray:
    """Index of each element's successor within the block, -1 where it lies outside."""
    names, code = np.unique(c, return_inverse=True)
    width = int(max(at.max(), nat.max())) + 2
    key = code * width + at
    order = np.argsort(key, kind="stable")
    there = np.minimum(np.searchsorted(names, nc), len(names) - 1)
    known = (names[there] == nc) & (nat >= 0)
    wanted = there * width + nat
    place = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
    found = order[place]
    return np.where(known & (key[found] == wanted), found, -1)


def suffix_sums(elements: DataFrame, weights: Sequence[str]) -> DataFrame:
    """c, at and each of ``weights`` summed from the element to the end of its list."""
    weights = list(weights)
    names = ["c", "at", "nc", "nat"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        c, at, nc, nat = (table.column(x).to_numpy() for x in names)
        after = _successors(c, at, nc, nat)
        sums, last = jump(after, np.stack([table.column(w).to_numpy() for w in weights], axis=1))
        first = np.ones(len(c), dtype=bool)
        first[after[after >= 0]] = False
        return pa.RecordBatch.from_pydict({"c": c, "at": at, "nc": nc[last], "nat": nat[last], **{w: sums[:, i] for i, w in enumerate(weights)}, "first": first})

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    columns = [*names, *weights]
    schema = ", ".join(f"{x} long" for x in columns) + ", first boolean"
    placed = elements.select(*[F.col(x).cast("long") for x in columns]).repartitionByRange("c", "at").mapInArrow(contract, schema)
    blocks = written(placed, "list-blocks")
    chains = blocks.filter("first").select(*columns)
    for _ in range(MAX_ROUNDS):
        if chains.filter("nat >= 0").isEmpty():
            break
        hop = chains.select(F.col("c").alias("nc"), F.col("at").alias("nat"), F.col("nc").alias("c2"), F.col("nat").alias("at2"), *[F.col(w).alias(f"{w}_2") for w in weights])
        longer = chains.filter("nat >= 0").join(hop, ["nc", "nat"]).select(
            "c", "at", F.col("c2").alias("nc"), F.col("at2").alias("nat"), *[(F.col(w) + F.col(f"{w}_2")).alias(w) for w in weights]
        )
        chains = written(longer.unionByName(chains.filter("nat < 0")), "list-chains")
    else:
        raise RuntimeError(f"the list was not ranked in {MAX_ROUNDS} rounds")
    rest = chains.select(F.col("c").alias("nc"), F.col("at").alias("nat"), *[F.col(w).alias(f"{w}_2") for w in weights])
    return blocks.join(rest, ["nc", "nat"], "left").select(
        "c", "at", *[(F.col(w) + F.coalesce(F.col(f"{w}_2"), F.lit(0).cast("long"))).alias(w) for w in weights]
    )
