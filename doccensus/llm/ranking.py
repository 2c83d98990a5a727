"""Document quality by pairwise ranking (Bradley-Terry).

A document's score is linear in features of its whole text. Training takes pairs of a document of label 1 and one of
label 0 and fits the weights by logistic loss on the difference of their features, with Newton steps. The cut is the
quantile of the training scores at the share of label 0; the logistic function around it gives a number from 0 to 1.

The fit runs on at most ``MAX_LABELLED`` labelled texts, those with the least hash of ``doc_id``, and ``PAIRS`` pairs
of them: labels are bounded before the join, their distinct (doc_id, label, text) after it, so that repeated rows of a
labelled document neither weigh more nor come to the driver. Scoring covers every row of the table in one pass without
a shuffle.

Defined cases: null and empty texts have the features of an empty text; labels without a text or with a null label are
left out; a document with several labels counts with each, an id with several texts with each; repeated rows and labels
count once; without labels of both kinds all scores are 0.5; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
PAIRS = 200_000
RIDGE = 1e-3
_LETTERS = np.zeros(256)
_LETTERS[list(range(65, 91)) + list(range(97, 123))] = 1
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#*$%&<>", b".", b",", b"?;:'\"()-", b"\n", b" ", bytes(range(128, 256)), b"@/_=\\[]{}~^`+"]


def features(text: str | None) -> np.ndarray:
    """Shares of character groups and word statistics of a whole text, on a log scale."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    shares = [counts[list(g)].sum() / n for g in _GROUPS]
    words = (text or "").split()
    m = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x]
    extra = [
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(words)) / m,
        sum(map(str.isupper, words)) / m,
        sum(map(str.isalpha, words)) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        len(raw) / m / 20,
    ]
    values = np.log(np.array(shares + extra) + 1e-3)
    return np.concatenate([values, values**2, [np.log1p(len(words)), np.log1p(len(words)) ** 2]])


def _feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else None) for t in texts]).reshape(len(texts), len(features(None)))


class BradleyTerry:
    """Weights over standardised features and the cut."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 11):
        self.mean = x.mean(axis=0) if len(x) else 0.0
        self.scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else 1.0
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        self.weights, self.cut = None, 0.0
        if not len(good) or not len(bad):
            return
        z = (x - self.mean) / self.scale
        draw = np.random.default_rng(seed)
        diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            gradient = diff.T @ (p - 1) / pairs + ridge * w
            hessian = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut = float(np.quantile(z @ w, len(bad) / (len(good) + len(bad)), method="midpoint"))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights - self.cut, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, pairs: int = PAIRS) -> BradleyTerry:
    """The model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text)."""
    # at most max_labelled rows of two numbers, so the broadcast has a fixed bound
    taken = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "same": b["same"], "x": list(_feature_rows(b["text"]))})

    joined = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("same")).join(F.broadcast(taken), "doc_id")
    found = joined.mapInPandas(rows, "doc_id long, quality int, same string, x array<double>")
    # equal texts have equal features; the limit bounds what comes to the driver, whatever number of texts an id has
    once = found.groupBy("doc_id", "quality", "same").agg(F.first("x").alias("x"))
    got = once.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "same").limit(max_labelled).toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), len(features(None)))
    return BradleyTerry(x, got["quality"].to_numpy(), pairs)


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score and predicted label of every document; the text is the only input."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(_feature_rows(b["text"])) if len(b) else np.empty(0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype("int32")})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, "doc_id long, score double, predicted int")
