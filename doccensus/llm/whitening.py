"""Whitening of embeddings by an incremental eigendecomposition.

Every entry c becomes the integer floor(scale * c) + offset. The covariance V is that of the *fit list*, each distinct integer
vector once, with divisor n. Its eigenvectors are found without ever building V in one place:

1. Exact integer sums give the mean, so every fit vector can be centred as (n x - S) / n without cancellation.
2. Each partition of the fit list starts from the zero matrix and applies one rank-one update for each centred vector:
   it solves the secular equation in the current eigenbasis, after deflation (``spectra``).
3. Spectra of partitions are combined ``FAN`` at a time, in levels, by applying the eigenvectors of one as rank-one updates
   of the other. A spectrum has dims * (dims + 1) numbers, whatever the rows.
4. A distributed Rayleigh-Ritz step projects V on the basis found, one dims x dims matrix for each partition, and turns
   the basis by the eigenvectors of that small matrix. This takes rounding of the many updates out again.
5. One more pass measures the covariance of the whitened fit list.

What comes to the driver: sums per dimension, one spectrum, two small matrices. Passes over the fit list read a written
table, so a lost executor costs its own tasks.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out, as are rows whose vector has
another length than most have (the longer of equally frequent ones stays); null ids stay; repeated rows give their rows
each; equal eigenvalues have any orthonormal basis; components whose eigenvalue is at most ``RANK`` of the largest do not
count, so constant data and fewer than two distinct vectors give no rows; an empty table gives no rows. An overflow of
the exact 64-bit sums is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.llm import spectra
from doccensus.llm.shared import written

SCALE, OFFSET = 64, 1_000_000
#: fit vectors of one task of the incremental step, which takes about a millisecond for each
SHARE = 4096
#: spectra that one task combines
FAN = 8
#: eigenvalues up to this part of the largest are rounding
RANK = 1e-9

_SPECTRUM = "part long, vals array<double>, vecs array<double>"


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """key, x: usable rows with their integer vectors, all of one length."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = table.select(F.col(key), F.col(vector).alias("_vector")).filter(F.col("_vector").isNotNull() & ~F.exists("_vector", bad))
    rows = usable.select(key, F.transform("_vector", lambda e: F.floor(e.cast("double") * scale) + offset).alias("x"))
    usual = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    return rows.filter(F.size("x") == (usual["dims"] if usual else -1))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def partition_spectra(fit: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """One spectrum of centred scatter for each partition of the fit list that has rows."""
    dims = len(sums)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = spectra.nothing(dims), False
        for batch in batches:
            for v in _centred(_matrix(batch, dims), n, sums):
                found, seen = spectra.update(*found, v), True
        if seen:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "vals": [found[0]], "vecs": [found[1].ravel()]})

    return fit.mapInArrow(grow, _SPECTRUM)


def combined(parts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of all parts, numbered below ``count``, in levels of ``FAN``."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        pairs = [(np.asarray(v), np.asarray(q).reshape(len(v), len(v))) for v, q in zip(rows["vals"], rows["vecs"], strict=True)]
        total = pairs[0]
        for other in pairs[1:]:
            total = spectra.merge(total, other)
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN], "vals": [total[0]], "vecs": [total[1].ravel()]})

    while count > 1:
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInPandas(join, _SPECTRUM), "spectra")
        count = -(-count // FAN)
    row = parts.first()
    return np.array(row["vals"]), np.array(row["vecs"]).reshape(len(row["vals"]), -1)


def projected_scatter(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """basis' V basis: a small matrix from every partition, summed cell by cell."""
    dims, width = len(sums), basis.shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = _centred(_matrix(batch, dims), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cells": [total.ravel()]})

    cells = fit.mapInArrow(gather, "cells array<double>").select(F.posexplode("cells").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(width * width)
    for at, v in cells:
        flat[at] = v
    return flat.reshape(width, width) / n


def components_of(fit: DataFrame, most: int = 16) -> dict | None:
    """n, sums, the unit components as columns with their eigenvalues (falling), the trace and the identity error."""
    totals = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    if not totals or totals[0]["n"] < 2:
        return None
    n, sums = totals[0]["n"], np.array([r["s"] for r in totals], dtype=np.int64)
    shares = -(-n // SHARE)
    spread = written(partition_spectra(fit.repartition(shares, "x"), n, sums), "spectra")
    # the cluster may deal out more partitions than asked for
    last = spread.agg(F.max("part")).first()[0]
    vectors = combined(spread, last + 1)[1]
    basis = np.linalg.qr(vectors)[0]
    small = projected_scatter(fit, n, sums, basis)
    e, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-e)
    e, basis = e[order], basis @ turn[:, order]
    keep = min(most, int((e > RANK * e[0]).sum())) if e[0] > 0 else 0
    if keep == 0:
        return None
    basis = basis[:, :keep]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    white = basis / np.sqrt(e[:keep])
    error = np.abs(projected_scatter(fit, n, sums, white) - np.eye(keep)).max()
    return {"n": n, "sums": sums, "vectors": basis, "values": e[:keep], "trace": e.sum(), "identity_error": float(error)}


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    off = n * x - sums
    if len(off) and int(np.abs(off).max()) ** 2 * off.shape[1] >= 2**63:
        return np.array([sum(int(v) ** 2 for v in row) for row in off], dtype=object)
    return (off * off).sum(axis=1)


def project(rows: DataFrame, key: str, found: dict) -> DataFrame:
    """key, component, deviation, whitened of all rows (key, x)."""
    n, sums, dims = found["n"], found["sums"], len(found["sums"])
    white = found["vectors"] / np.sqrt(found["values"])
    schema = f"id {rows.schema[key].dataType.simpleString()}, deviation long, coords array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            coords = pa.array(list(_centred(x, n, sums) @ white), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_deviation(x, n, sums), pa.int64()), coords], ["id", "deviation", "coords"])

    placed = rows.select(F.col(key).alias("id"), "x").mapInArrow(place, schema)
    return placed.select(F.col("id").alias(key), "deviation", F.posexplode("coords").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), "deviation", "whitened"
    )


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row for each usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = integer_vectors(table, key, vector)
    found = components_of(written(rows.select("x").distinct(), "fit-list"), components)
    if found is None:
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.select(key, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).limit(0)
    share: Column = F.element_at(F.array(*[F.lit(float(e / found["trace"])) for e in found["values"]]), F.col("component"))
    return project(rows, key, found).select(
        key, "component", F.lit(found["n"]).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"),
        F.lit(found["identity_error"]).alias("identity_error"),
    )
