"""Exact cosine top k over an inverted file of vectors.

Vectors are dealt to the cells of a k-means fit. With the cosine t between a query and a cell's centroid, and the cosines
of the cell's vectors with it known to lie in [lo, hi], Cauchy-Schwarz bounds the similarity of any vector x of the cell:
q.x <= t s + sqrt(1 - t^2) sqrt(1 - s^2) for s = x.c, largest at s = t if that lies in the range, else at its nearer end.
A query is first held against the cells nearest to it, until they hold k vectors; what it finds there bounds its k-th best
similarity from below, and only cells whose bound reaches that are compared. Vectors that lie in groups let most cells go;
vectors without any structure in many dimensions let none go, and the search is then a full one in blocks.

Vectors of a cell and the queries that visit it are cut into blocks of about ``block`` rows; each pair of blocks is one
matrix product that keeps k rows for each query, so neither a hot cell nor a popular one meets one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.functions.common import settled, top_k

#: rows that the centroids are fitted on, the first by the hash of their key; all rows are indexed
SAMPLE = 8192
MAX_CELLS = 256
#: similarities this close to a bound are compared
SLACK = 1e-9
#: cell of zero vectors, whose similarity with anything is 0
ZERO = -1


@dataclass(frozen=True)
class Cells:
    """For each cell its number, size, range of cosines and centroid; small, so that tasks carry it."""

    cells: np.ndarray
    sizes: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    centroids: np.ndarray


@dataclass(frozen=True)
class VectorIndex:
    """``vectors`` (cell, page_key, vec) with unit vectors, and the cells they lie in."""

    vectors: DataFrame
    grid: Cells


def _unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on unit vectors, begun with vectors far from each other."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen].copy()
    for _ in range(rounds):
        at = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), centroids)
    return centroids


def build_index(page_vecs: DataFrame, cells: int | None = None) -> VectorIndex:
    """Index of ``page_vecs`` (page_key, embedding); by default the root of the sample's size as the number of cells."""
    sample = page_vecs.orderBy(F.xxhash64("page_key"), "page_key").limit(SAMPLE).toPandas()
    units = _unit(sample["embedding"]) if len(sample) else np.zeros((0, 0))
    units = units[np.abs(units).sum(axis=1) > 0]
    centroids = fit_centroids(units, cells or min(MAX_CELLS, int(np.ceil(np.sqrt(max(1, len(units)))))))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            m = _unit(frame["embedding"])
            full = np.abs(m).sum(axis=1) > 0
            near, cos = np.full(len(m), ZERO), np.zeros(len(m))
            if full.any():
                sims = m[full] @ centroids.T
                near[full], cos[full] = sims.argmax(axis=1), sims.max(axis=1)
            yield pd.DataFrame({"cell": near, "page_key": frame["page_key"].to_numpy(), "vec": pd.Series(list(m), dtype=object), "cos": cos})

    vectors = settled(page_vecs.select("page_key", "embedding").mapInPandas(deal, "cell int, page_key long, vec array<double>, cos double"))
    # a row for each cell comes to the driver
    found = vectors.groupBy("cell").agg(F.count("*").alias("n"), F.min("cos").alias("lo"), F.max("cos").alias("hi")).orderBy("cell").toPandas()
    of_cell = found["cell"].to_numpy()
    middle = np.stack([centroids[x] if x != ZERO else np.zeros(centroids.shape[1]) for x in of_cell]) if len(found) else centroids
    return VectorIndex(vectors.drop("cos"), Cells(of_cell, found["n"].to_numpy(), found["lo"].to_numpy(), found["hi"].to_numpy(), middle))


def bounds(grid: Cells, queries: np.ndarray) -> np.ndarray:
    """Upper bound of the similarity of every unit query with the vectors of every cell."""
    t = np.clip(queries @ grid.centroids.T, -1, 1)
    s = np.clip(t, np.clip(grid.lows, -1, 1), np.clip(grid.highs, -1, 1))
    bound = t * s + np.sqrt(1 - t * t) * np.sqrt(1 - s * s)
    empty = np.abs(queries).sum(axis=1) == 0
    bound[:, grid.cells == ZERO] = 0
    bound[empty] = 0
    return bound


def visits(issue_vecs: DataFrame, index: VectorIndex, k: int, reached: DataFrame | None = None) -> DataFrame:
    """issue_id, vec, cell: the cells of the first look, or with ``reached`` (issue_id, similarity) all others that can matter."""
    asked = issue_vecs.select("issue_id", "embedding")
    asked = asked.withColumn("reached", F.lit(None).cast("double")) if reached is None else asked.join(reached, "issue_id", "left")
    opening, grid = reached is None, index.grid

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame) or not len(grid.cells):
                continue
            q = _unit(frame["embedding"])
            best = bounds(grid, q)
            order = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(grid.sizes[order], axis=1) - grid.sizes[order]
            first = np.zeros(best.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            least = frame["reached"].fillna(-2).to_numpy()[:, None] - SLACK
            row, cell = np.nonzero(first if opening else ~first & (best >= least))
            yield pd.DataFrame({"issue_id": frame["issue_id"].to_numpy()[row], "vec": pd.Series([q[i] for i in row], dtype=object), "cell": grid.cells[cell]})

    return asked.mapInPandas(pick, "issue_id long, vec array<double>, cell int")


def _blocks(cell: Column, sizes: dict[int, int], block: int) -> Column:
    """Number of blocks of each cell, as an expression."""
    many = {c: -(-n // block) for c, n in sizes.items() if n > block}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("int") for kv in many.items() for x in kv]), cell), F.lit(1)) if many else F.lit(1)


def _compare(asked: DataFrame, index: VectorIndex, k: int, block: int) -> DataFrame:
    """issue_id, page_key, similarity: the best ``k`` of every pair of blocks of a visited cell."""
    # a row for each cell comes to the driver
    callers = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    held = {int(c): int(n) for c, n in zip(index.grid.cells, index.grid.sizes, strict=True)}
    a, b = _blocks(F.col("cell"), callers, block), _blocks(F.col("cell"), held, block)
    # the keys have the same types on both sides, or their hashes would send equal blocks to different tasks
    left = asked.select("cell", "issue_id", "vec", F.pmod(F.xxhash64("issue_id"), a).cast("int").alias("qa"), F.explode(F.sequence(F.lit(0), b - 1)).alias("pb"))
    right = index.vectors.select("cell", "page_key", "vec", F.pmod(F.xxhash64("page_key"), b).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), a - 1)).alias("qa"))
    right = right.filter(F.col("cell").isin(list(callers))) if callers else right.limit(0)

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("page_key")
            pages, keys = np.stack(p["vec"].to_numpy()).T, p["page_key"].to_numpy()
            for start in range(0, len(q), 512):
                part = q.iloc[start : start + 512]
                sims = np.stack(part["vec"].to_numpy()) @ pages
                n = min(k, sims.shape[1])
                # all rows at or above the k-th value keep ties together
                cut = -np.partition(-sims, n - 1, axis=1)[:, n - 1 : n]
                for row, issue in enumerate(part["issue_id"].to_numpy()):
                    idx = np.flatnonzero(sims[row] >= cut[row] - 1e-12)
                    idx = idx[np.lexsort((keys[idx], -sims[row, idx]))][:n]
                    out.append((np.full(len(idx), issue), keys[idx], sims[row, idx]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(["issue_id", "page_key", "similarity"], columns, strict=True)))

    by = ["cell", "qa", "pb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, "issue_id long, page_key long, similarity double")


def search(issue_vecs: DataFrame, index: VectorIndex, k: int = 5, block: int = 8192) -> DataFrame:
    """issue_id, page_key, similarity, rank: the ``k`` most similar vectors of every query, ties by page_key."""
    order = [F.col("similarity").desc(), F.col("page_key")]
    near = settled(top_k(_compare(settled(visits(issue_vecs, index, k)), index, k, block), ["issue_id"], order, k, ["page_key"]).drop("rank"))
    reached = near.groupBy("issue_id").agg(F.min("similarity").alias("reached"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
    rest = settled(visits(issue_vecs, index, k, reached))
    return top_k(near.unionByName(_compare(rest, index, k, block)), ["issue_id"], order, k, ["page_key"])
