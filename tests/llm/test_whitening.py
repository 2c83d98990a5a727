"""Secular updates and whitening against dense eigenvalue routines."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doccensus.llm import spectra, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id int, coords int"


def _by_updates(rows, dims):
    found = spectra.nothing(dims)
    for v in rows:
        found = spectra.update(*found, v)
    return found


def _close(found, scatter):
    e = np.linalg.eigvalsh(scatter)
    scale = max(e[-1], 1e-300)
    assert np.abs(found[0] - e).max() <= 1e-12 * scale
    assert np.abs(found[1].T @ found[1] - np.eye(len(e))).max() < 1e-11
    assert np.abs((found[1] * found[0]) @ found[1].T - scatter).max() <= 1e-12 * scale


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.lists(st.lists(st.integers(-3, 3), min_size=7, max_size=7), max_size=25))
def test_updates_equal_the_dense_spectrum(dims, rows):
    """Small integers bring about equal values, zero vectors and repeated rows."""
    m = np.array(rows, dtype=float).reshape(-1, 7)[:, :dims]
    _close(_by_updates(m, dims), m.T @ m)


@pytest.mark.parametrize("kind", ["normal", "graded", "low rank"])
def test_merge(kind):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 24)) * (np.logspace(-7, 3, 24) if kind == "graded" else 1)
    if kind == "low rank":
        m = m[:, :5] @ rng.normal(size=(5, 24))
    _close(spectra.merge(_by_updates(m[::2], 24), _by_updates(m[1::2], 24)), m.T @ m)


def _brute(rows, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(e)))) + 1_000_000 for e in v] for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    keep = min(most, int((e > 1e-9 * e[0]).sum()))
    white = (n * x - sums) / n @ q[:, :keep] / np.sqrt(e[:keep])
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
    return [i for i, _ in kept], n, dev, white, e[:keep] / e.sum()


def test_whitening_is_the_dense_result(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SHARE", 37)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a third of all rows are one vector
    rows += [(2, None), (3, [None] * 20), (4, [float("nan")] * 20), (5, [float("inf")] + [0.0] * 19), (6, [1.0, 2.0]), (7, [])]
    odd = [(2000, rows[0][1]), (2000, rows[0][1]), (None, rows[1][1])]
    ids, n, dev, white, share = _brute([*rows[:-2], *odd])
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in [*rows, *odd]], SCHEMA).repartition(5)
    got = whitening.whiten(table).toPandas()
    assert len(got) == len(ids) * 16
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    sign = None
    for key, part in got[got["vec_id"].notna() & (got["vec_id"] != 2000)].groupby("vec_id"):
        part, at = part.sort_values("component"), ids.index(key)
        assert list(part["component"]) == list(range(1, 17)) and (part["deviation"] == dev[at]).all()
        np.testing.assert_allclose(part["explained"], share, rtol=1e-9)
        sign = np.sign(part["whitened"].to_numpy() * white[at]) if sign is None else sign
        np.testing.assert_allclose(part["whitened"].to_numpy(), sign * white[at], atol=1e-7)
    assert got["vec_id"].isna().sum() == 16 and (got["vec_id"] == 2000).sum() == 32


def test_large_deviations_are_exact():
    x, sums = np.array([[5, 1_000_000_000], [7, 3]], dtype=np.int64), np.array([0, 0])
    assert list(whitening._deviation(x, 2, sums)) == [10**2 + 2_000_000_000**2, 14**2 + 6**2]
    beyond = whitening._deviation(x, 1000, sums)
    assert beyond[0] == 5000**2 + 10**24
    with pytest.raises(OverflowError):
        pa.array(beyond, pa.int64())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [3.0, 3.0]) for i in range(9)], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, [float(a), float(b), float(a + b)], "x", 1, 2) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))], SCHEMA)
    got = whitening.whiten(table)
    assert [r[0] for r in got.select("component").distinct().orderBy("component").collect()] == [1, 2]
    assert got.first()["identity_error"] < 1e-8
