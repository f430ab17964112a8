"""Leading eigenvectors of one symmetric matrix: tridiagonal form, bisection, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the matrix' norm are one cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors): H a H is tridiagonal for the product H of the reflections."""
    a = np.array(matrix, dtype=float)
    d, vectors = len(a), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() > 0:
            # Away from zero, so nothing cancels.
            turned = -np.copysign(np.linalg.norm(v), v[0])
            v[0] -= turned
            v /= np.linalg.norm(v)
            low = a[k + 1 :, k + 1 :]
            p = low @ v
            w = p - (v @ p) * v
            low -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = turned
            a[k + 2 :, k] = a[k, k + 2 :] = 0
        else:
            v = np.zeros(d - k - 1)
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def reflected(vectors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal form in the coordinates of the matrix."""
    out = y.copy()
    for k in range(len(vectors) - 1, -1, -1):
        v = vectors[k]
        out[k + 1 :] -= 2 * (v @ out[k + 1 :]) * v
    return out


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: eigenvalues below each of the places ``at``."""
    squares = off * off
    least = max(np.finfo(float).tiny, EPS * EPS * squares.max(initial=0.0))
    q = diagonal[0] - at
    below = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - at - squares[i - 1] / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until no double lies between the ends."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    margin = EPS * max(1.0, np.abs(low).max(), np.abs(high).max())
    low, high = low - margin, high + margin
    rank = d - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        over = counts_below(diagonal, off, middle) > rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; pivots smaller than ``least`` are put at it."""
    d = len(diagonal)
    main = (diagonal - shift).tolist()
    below = [*off.tolist(), 0.0]
    above, second, y = below.copy(), [0.0] * d, right.tolist()
    for i in range(d - 1):
        if abs(below[i]) > abs(main[i]):
            main[i], below[i] = below[i], main[i]
            above[i], main[i + 1] = main[i + 1], above[i]
            second[i], above[i + 1] = above[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = below[i] / main[i]
        main[i + 1] -= factor * above[i]
        above[i + 1] -= factor * second[i]
        y[i + 1] -= factor * y[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            y[i] -= above[i] * y[i + 1]
        if i + 2 < d:
            y[i] -= second[i] * y[i + 2]
        y[i] /= main[i]
    return np.array(y)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns.

    Vectors of a multiple value are one orthonormal basis of its space among many."""
    d = len(matrix)
    k = min(k, d)
    scale = float(np.abs(matrix).max(initial=0.0))
    if k == 0 or scale == 0.0:
        return np.zeros(k), np.eye(d)[:, :k]
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng, found = np.random.default_rng(0), []
    for j in range(k):
        cluster = [found[i] for i in range(j) if abs(values[i] - values[j]) <= CLUSTER * norm]
        # Equal values are set apart a little, so that their systems differ.
        shift = values[j] - 2 * EPS * norm * len(cluster)
        y = rng.standard_normal(d)
        for _ in range(5):
            y = _solve(diagonal, off, shift, y / np.abs(y).max(), EPS * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in cluster:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    vectors = np.column_stack([reflected(reflections, y) for y in found])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)
