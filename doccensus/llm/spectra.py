"""Eigenvalues and eigenvectors of a growing scatter matrix, one rank-one update at a time; plain numpy.

A spectrum is (values, vectors): ascending eigenvalues and the unit eigenvectors as columns. ``update`` turns the spectrum
of C into that of C + v v'. In the old eigenbasis that is D + z z', whose eigenvalues are the roots of the secular
equation 1 + sum z_j^2 / (d_j - x) = 0, one between each two old values. Coordinates that cannot move are deflated
first: those with a vanishing z, and all but one of each group of equal values, whose part of the basis is reflected so
that z meets one member only.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def nothing(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the zero matrix."""
    return np.zeros(dims), np.eye(dims)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) for ascending distinct ``d`` and positive ``z2``.

    Returns the index of the pole next to each root and the root's distance from it, which keeps its digits where the
    root itself would round onto the pole. A bracketed iteration on the rational function that has the two poles
    around the root; where it leaves the bracket, the bracket is halved.
    """
    k = len(d)
    rows = np.arange(k)
    above = np.append(d[1:], d[-1] + z2.sum())
    half = (above - d) / 2
    middle = 1 + (z2 / (d - (d + half)[:, None])).sum(axis=1)
    near = np.where((middle >= 0) | (rows == k - 1), rows, rows + 1)
    delta = d - d[near][:, None]  # distance of every pole from the nearest one of each root
    low = np.where(near == rows, np.where(middle >= 0, 0.0, half), -half)
    high = np.where(near == rows, np.where(middle >= 0, half, above - d), 0.0)
    t = (low + high) / 2
    left, right = delta[rows, rows], delta[rows, np.minimum(rows + 1, k - 1)]
    below = rows[None, :] <= rows[:, None]
    for _ in range(80):
        gap = delta - t[:, None]
        terms = z2 / gap
        f = 1 + terms.sum(axis=1)
        slopes = terms / gap
        low, high = np.where(f < 0, t, low), np.where(f >= 0, t, high)
        done = (np.abs(f) <= EPS * k * (1 + np.abs(terms).sum(axis=1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        ds, total = np.where(below, slopes, 0).sum(axis=1), slopes.sum(axis=1)
        l, r = left - t, right - t
        with np.errstate(all="ignore"):
            a = (l + r) * f - l * r * total
            b = l * r * f
            c = f - l * ds - r * (total - ds)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # above the last pole: one pole and a constant
            last = l[-1] + total[-1] * l[-1] ** 2 / (f[-1] - total[-1] * l[-1])
        step[-1] = last
        new = t + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        t = np.where(done, t, new)
    return near, t


def _reflect(z: np.ndarray, basis: np.ndarray) -> None:
    """Turn a group's basis in place so that z meets its last vector only."""
    size = np.linalg.norm(z)
    if size == 0:
        return
    w = z.copy()
    w[-1] += np.copysign(size, z[-1])
    basis -= np.outer(basis @ w, w) * (2 / (w @ w))
    z[:-1], z[-1] = 0, -np.copysign(size, z[-1])


def update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after adding v v'."""
    d, q = values.copy(), vectors.copy()
    z = q.T @ v
    size = np.linalg.norm(z)
    if size == 0:
        return d, q
    tol = 8 * EPS * max(abs(d[-1]), size * size)
    starts = np.flatnonzero(np.append(True, np.diff(d) > tol))
    ends = np.append(starts[1:], len(d))
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
        part = np.ascontiguousarray(q[:, a:b])
        _reflect(z[a:b], part)
        q[:, a:b] = part
    live = np.flatnonzero(np.abs(z) * size > tol)
    if len(live):
        old, zl = d[live], z[live]
        near, t = secular_roots(old, zl * zl)
        gaps = (old - old[near][:, None]) - t[:, None]  # old value j minus new value i, at [i, j]
        # the z for which these roots are exact, so that the vectors below are orthogonal
        k = len(live)
        ratio = -gaps.T  # new i minus old j, at [j, i]
        apart = old[None, :] - old[:, None]
        np.fill_diagonal(apart, 1.0)
        fixed = ratio[:, :-1] / np.where(np.arange(k - 1)[None, :] < np.arange(k)[:, None], apart[:, :-1], apart[:, 1:])
        zh = np.copysign(np.sqrt(np.abs(np.prod(fixed, axis=1) * ratio[:, -1])), zl)
        w = zh / gaps
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        q[:, live] = q[:, live] @ w.T
        d[live] = old[near] + t
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def merge(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum: the other's eigenvectors, scaled, are rank-one updates of the first."""
    values, vectors = one
    for x, u in zip(other[0], other[1].T, strict=True):
        if x > 0:
            values, vectors = update(values, vectors, u * np.sqrt(x))
    return values, vectors
