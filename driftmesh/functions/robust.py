"""Exact sign predicates with symbolic perturbation, vectorised over cells.

Each coordinate (vertex rank i, axis j) is perturbed by e ** 2 ** (i * d + d - 1 - j); the sign of a
determinant is that of its first nonzero coefficient in ascending powers of e. The terms are derived here
from that rule. Values are integers (fixed point); products beyond 63 bits fall back to Python integers.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np


@lru_cache
def _terms(d: int) -> tuple[tuple[tuple[int, ...], tuple[int, ...], int], ...]:
    """(kept rows, kept columns, sign) of each coefficient of the bordered (d+1)-determinant, by power."""
    found: dict[int, tuple] = {}
    for size in range(d + 1):
        for rows in combinations(range(d + 1), size):
            for cols in permutations(range(d), size):
                power = sum(2 ** (i * d + d - 1 - j) for i, j in zip(rows, cols))
                kept_r = tuple(i for i in range(d + 1) if i not in rows)
                kept_c = tuple(j for j in range(d) if j not in cols)
                flips = sum(a > b for k, b in enumerate(cols) for a in cols[:k]) + sum(rows) + sum(cols)
                found[power] = (kept_r, kept_c, -1 if flips % 2 else 1)
    out = []
    for power in sorted(found):
        out.append(found[power])
        if not found[power][1]:
            break
    return tuple(out)


def _det(m: np.ndarray) -> np.ndarray:
    """Determinants of (n, k, k) matrices by expansion, exact for integers."""
    k = m.shape[1]
    if k == 1:
        return m[:, 0, 0]
    if k == 2:
        return m[:, 0, 0] * m[:, 1, 1] - m[:, 0, 1] * m[:, 1, 0]
    out = 0
    for j in range(k):
        rest = np.delete(m[:, 1:, :], j, axis=2)
        out = out + (m[:, 0, j] * _det(rest) if j % 2 == 0 else -m[:, 0, j] * _det(rest))
    return out


def sign_det(x: np.ndarray) -> np.ndarray:
    """Perturbed sign of the bordered determinant of (n, d+1, d) points whose ranks ascend; never 0."""
    n, _, d = x.shape
    if x.dtype != object and n and float(np.abs(x).max()) ** d * 2 * (d + 1) >= 2.0**62:
        x = x.astype(object)
    out = np.zeros(n, np.int64)
    todo = np.arange(n)
    for rows, cols, sign in _terms(d):
        if not len(todo):
            break
        m = np.ones((len(todo), len(rows), len(rows)), x.dtype)
        for a, r in enumerate(rows):
            for b, c in enumerate(cols):
                m[:, a, b] = x[todo, r, c]
        got = sign * np.sign(_det(m)).astype(np.int64)
        out[todo] = got
        todo = todo[got == 0]
    return out


def orientation(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Perturbed orientation of (n, d+1, d) simplices whose vertices have global ids."""
    order = np.argsort(ids, axis=1, kind="stable")
    k = ids.shape[1]
    flips = sum((order[:, a] > order[:, b]).astype(np.int64) for a in range(k) for b in range(a + 1, k))
    return np.where(flips % 2, -1, 1) * sign_det(np.take_along_axis(x, order[:, :, None], axis=1))


def point_in_simplex(x: np.ndarray, ids: np.ndarray, point: np.ndarray | int = 0, point_id: int = -1) -> np.ndarray:
    """Whether a point lies in each of n d-simplices; ties fall to exactly one of the neighbours."""
    whole = orientation(x, ids)
    inside = np.ones(len(x), bool)
    for i in range(x.shape[1]):
        y, named = x.copy(), ids.copy()
        y[:, i, :] = point
        named[:, i] = point_id
        inside &= orientation(y, named) == whole
    return inside


def point_in_polygon(point, ids, corners) -> bool:
    """Even-odd test of a point (id 0, below all corners) in a polygon of integer corners with ids above 0."""
    inside = False
    n = len(ids)
    for k in range(n):
        a, b = (ids[k], corners[k]), (ids[(k + 1) % n], corners[(k + 1) % n])
        if (a[1][1], -a[0]) > (b[1][1], -b[0]):
            a, b = b, a
        low, high, at = (a[1][1], -a[0]), (b[1][1], -b[0]), (point[1], 0)
        if low < at <= high:
            x = np.array([[point, a[1], b[1]]], dtype=np.int64)
            if orientation(x, np.array([[0, a[0], b[0]]]))[0] > 0:
                inside = not inside
    return inside


def scaling_bits(resolution: float, least: int = 8, most: int = 21) -> int:
    """Bits of the fixed-point factor for a field's smallest nonzero magnitude."""
    if not np.isfinite(resolution) or resolution <= 0:
        return least
    return int(max(least, min(np.ceil(np.log2(1.0 / resolution)), most)))


def fixed_point(x: np.ndarray, bits: int) -> np.ndarray:
    """Integers of scaled values, cut toward zero."""
    return np.trunc(x * float(1 << bits)).astype(np.int64)
