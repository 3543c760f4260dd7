"""Eigendecompositions that grow by rank-one updates, with numpy: what a task of ``whitening`` does with its vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS, TINY = float(np.finfo(np.float64).eps), float(np.finfo(np.float64).tiny)


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots x of 1 + rho * sum(z2 / (d - x)), as (number of the pole that a root is measured from, distance from it).

    d ascends, without equal values; z2 and rho are above 0. Each root lies between two poles, the last within rho * sum(z2)
    above the last pole. It is measured from the nearer pole, so that differences to poles keep their digits, and found by
    fitting the sums over the poles below and above it by one pole each; bisection takes over where that leaves the bracket.
    """
    k = len(d)
    top = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (top - d) / 2
    lower = np.tri(k)  # poles up to root i

    def value(origin: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the poles below and above each root, and their slopes, without the factor rho."""
        gap = (d[None, :] - d[origin][:, None]) - t[:, None]
        gap[gap == 0] = TINY
        inverse = 1 / gap
        below = inverse * lower
        low, dlow = below @ z2, (below * inverse) @ z2
        return low, inverse @ z2 - low, dlow, (inverse * inverse) @ z2 - dlow

    low, high, *_ = value(np.arange(k), half)
    middle, unit = 1 / rho + low + high, 1 / rho
    right = (middle < 0) & (np.arange(k) < k - 1)  # the root is nearer to the upper pole
    origin = np.arange(k) + right
    lo, hi = np.where(right, -half, np.where(middle < 0, half, 0.0)), np.where(right, 0.0, np.where(middle < 0, 2 * half, half))
    below, above = np.where(right, -2 * half, 0.0), np.where(right, 0.0, 2 * half)  # the poles at both ends, from the origin
    old = np.seterr(all="ignore")
    t, last, open_ = (lo + hi) / 2, np.arange(k) == k - 1, np.ones(k, bool)
    fits = lambda y: np.isfinite(y) & (t + y > lo) & (t + y < hi)
    for _ in range(100):
        low, high, dlow, dhigh = value(origin, t)
        f = unit + low + high
        lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
        open_ &= np.abs(f) > k * EPS * (unit + np.abs(low) + np.abs(high))
        # low ~ a + p / (below - x), high ~ b + q / (above - x), with the same values and slopes at t
        s, r = below - t, above - t
        p, q = dlow * s * s, np.where(last, 0.0, dhigh * r * r)
        c = unit + (low - dlow * s) + np.where(last, 0.0, high - dhigh * r)
        # c (s - y)(r - y) + p (r - y) + q (s - y) = 0 for the step y
        a1, a0 = -(c * (s + r) + p + q), c * s * r + p * r + q * s
        root = np.sqrt(np.maximum(a1 * a1 - 4 * c * a0, 0))
        one, two = np.where(last, s + p / c, 2 * a0 / (-a1 + root)), 2 * a0 / (-a1 - root)
        new = np.where(fits(one), t + one, np.where(fits(two), t + two, (lo + hi) / 2))
        moved = np.where(open_, new, t)
        open_ &= np.abs(new - t) > 2 * EPS * np.abs(new)
        t = moved
        if not open_.any():
            break
    np.seterr(**old)
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors (columns) of ``Q diag(values) Q' + rho v v'`` for rho above 0.

    Components of v along which nothing changes are deflated: those of nearly no size, and all but one among equal eigenvalues,
    which a rotation makes so. The rest solves the secular equation; z is recomputed from the roots, so that eigenvectors stay
    orthogonal however close the roots are.
    """
    z = vectors.T @ v
    size = float(np.linalg.norm(z))
    if not size or not rho:
        return values, vectors
    z, rho = z / size, rho * size * size
    scale = max(float(np.abs(values).max()), rho)
    tol = 8 * EPS * scale
    z[np.abs(z) * rho <= tol] = 0.0
    if (np.diff(values) <= tol).any():
        values, vectors = values.copy(), vectors.copy()
        last = -1
        for i in np.flatnonzero(z):
            if last >= 0 and values[i] - values[last] <= tol:  # turn the pair so that only the later one has a part of v
                r = np.hypot(z[i], z[last])
                c, s = z[i] / r, z[last] / r
                a, b = vectors[:, last].copy(), vectors[:, i].copy()
                vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
                z[last], z[i] = 0.0, r
            last = i
    live = np.flatnonzero(z)
    d, w = values[live], z[live]
    origin, t = _roots(d, w * w, rho)
    gaps = (d[:, None] - d[origin][None, :]) - t[None, :]  # pole i minus root j
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1.0)
    ratio = -gaps / np.where(np.eye(len(d), dtype=bool), 1.0, -poles)
    weight = np.sqrt(np.abs(ratio.prod(axis=1) / rho)) * np.sign(w)
    turned = weight[:, None] / gaps
    turned /= np.linalg.norm(turned, axis=0)
    out, rows = values.copy(), vectors.copy()
    out[live], rows[:, live] = d[origin] + t, vectors[:, live] @ turned
    order = np.argsort(out, kind="stable")
    return out[order], rows[:, order]


@dataclass
class Spectrum:
    """Rows seen, their mean, and the eigendecomposition of their centred scatter matrix."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """One more row: the scatter grows by n / (n + 1) times the square of the row's difference from the mean."""
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n / (self.n + 1), away)
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """All rows of another: its eigenpairs and the difference of means are rank-one updates."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        away, n = other.mean - self.mean, self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, away)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes, dims: int) -> Spectrum:
        a = np.frombuffer(data, "<f8")
        return cls(int(a[0]), a[1 : dims + 1].copy(), a[dims + 1 : 2 * dims + 1].copy(), a[2 * dims + 1 :].reshape(dims, dims).copy())
