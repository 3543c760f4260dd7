"""Logistic fits of leave-one-out by expansion: each place is a fold that trains on the rows farther than r, and rows of a place share its fit.

The loss is a sum over rows, so a fold's loss is that of all rows minus that of the rows near its place. Both are expanded around the fit on
all rows: the first as one polynomial for all folds, the second as a polynomial of low degree for each place, summed by cells of side r.
Newton's steps on these polynomials are a task's own work, so the rows are read some times in all, not once for each fold. A fold whose
fit lies too far from that of all rows for the expansion (its remainder has a bound) is not ok, and left to ``newton.fit_folds``.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.newton import SLICE, Folds, by_block, fit_all, inputs, moments_of, solved
from scarpline.operators.spatial import cells, placed
from scarpline.sources.tables import saved

#: Degrees of the expansions and how many terms they may have: of all rows, and of the rows near a place; a degree of 2 is had anyway.
WIDE, NEAR = (9, 8000), (5, 200)
#: Places and rows that a group measures against each other at most, on average, and places that are solved together.
SITES, ROWS, SOLVED = 2000, 50_000, 2000
#: What the terms left out may add to a gradient, for each unit of weight.
REMAINDER = 1e-10


class _Terms:
    """The products of up to ``degree`` of k variables, by degree; derivatives of the loss are looked up among them."""

    def __init__(self, k: int, degree: int) -> None:
        self.k, self.degree = k, degree
        self.names = [t for m in range(1, degree + 1) for t in combinations_with_replacement(range(k), m)]
        self.at = {t: i for i, t in enumerate(self.names)}
        self.degrees = np.array([len(t) for t in self.names])
        self.scale = np.array([1.0] + [1 / math.prod(math.factorial(t.count(j)) for j in set(t)) for t in self.names])
        below = [(), *self.names]
        upper = [(j, m) for j in range(k) for m in range(j, k)]
        up = lambda t, more: self.at[tuple(sorted((*t, *more)))]
        self.first = np.array([[up(t, (j,)) for j in range(k)] for t in below if len(t) < degree])
        self.second = np.array([[up(t, jm) for jm in upper] for t in below if len(t) < degree - 1])

    def of(self, x: np.ndarray) -> np.ndarray:
        """terms x rows."""
        out, columns = np.empty((len(self.names), len(x))), np.ascontiguousarray(x.T)
        for i, t in enumerate(self.names):
            out[i] = columns[t[0]] if len(t) == 1 else out[self.at[t[:-1]]] * columns[t[-1]]
        return out


def _terms(k: int) -> tuple[_Terms, _Terms]:
    wide, low = (_Terms(k, max(m for m in range(2, most + 1) if m == 2 or math.comb(k + m, m) <= terms)) for most, terms in (WIDE, NEAR))
    return wide, low


def _parts(x: np.ndarray, middle: np.ndarray, terms: _Terms) -> np.ndarray:
    """For each row (a column): one, features, their squares, and the derivatives of softplus at ``middle`` times the terms."""
    p = 1 / (1 + np.exp(-np.clip(x @ middle, -500, 500)))
    curve, products = np.polynomial.Polynomial([0.0, 1.0]), terms.of(x)
    for m in range(1, terms.degree + 1):
        products[terms.degrees == m] *= curve(p)
        curve = curve.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
    return np.vstack([np.ones(len(x)), x[:, :-1].T, x[:, :-1].T ** 2, products])


def _fits(total: np.ndarray, near: np.ndarray, middle: np.ndarray, reach: np.ndarray, c: float, rounds: int, tolerance: float) -> tuple[Folds, np.ndarray]:
    """The fits of places whose near rows' sums are the rows of ``near``, and which of them are ok. reach: the largest size of each variable."""
    k = len(middle)
    d, n = k - 1, len(near)
    wide, low = _terms(k)
    total, near = total.reshape(2, -1), near.reshape(n, 2, -1)
    head = total[None, :, : 1 + 2 * d] - near[:, :, : 1 + 2 * d]
    counts, mean, sd = moments_of(np.rint(head[:, :, 0]), head[:, :, 1 : 1 + d].sum(axis=1), head[:, :, 1 + d :].sum(axis=1))
    size = counts.sum(axis=1)
    begin = np.column_stack([middle[:-1] * sd, middle[-1] + mean @ middle[:-1]])
    found = Folds(np.arange(n), counts, mean, sd, np.zeros((n, k)))
    found = Folds(found.names, counts, mean, sd, np.where(found.usable[:, None], begin, 0.0))
    weight = np.divide(size[:, None], 2 * counts, out=np.zeros_like(counts), where=counts > 0)
    rest = near[:, :, 1 + 2 * d :]
    more = total[:, 1 + 2 * d :]
    upper = np.triu_indices(k)
    plain = np.column_stack([head[:, 1, 1 : 1 + d], head[:, 1, 0]])  # the targets' part of the gradient
    off = lambda raw: np.abs(raw - middle) @ reach

    def sums(raw: np.ndarray) -> np.ndarray:
        here = off(raw) < math.pi
        power = np.column_stack([np.ones(n), wide.of(np.where(here[:, None], raw - middle, 0.0)).T]) * wide.scale
        gradient, hessian = -weight[:, 1:] * plain, np.zeros((n, len(upper[0])))
        for y in (0, 1):
            gradient += weight[:, [y]] * (power[:, : len(wide.first)] @ more[y][wide.first] - np.einsum("nt,ntj->nj", power[:, : len(low.first)], rest[:, y][:, low.first]))
            hessian += weight[:, [y]] * (power[:, : len(wide.second)] @ more[y][wide.second] - np.einsum("nt,ntj->nj", power[:, : len(low.second)], rest[:, y][:, low.second]))
        gradient[~here], hessian[~here] = 0.0, (upper[0] == upper[1]).astype(float)  # too far off to be ok
        return np.column_stack([gradient, hessian])

    beta, step = solved(found, sums, c, rounds, tolerance)
    found = Folds(found.names, counts, mean, sd, beta)
    part = np.minimum(off(found.raw()) / math.pi, 0.99)  # the nearest poles of the logistic function are pi away
    share = near[:, :, 0].sum(axis=1) / np.maximum(size, 1)
    left = 0.8 / (1 - part) * (part**wide.degree + share * part**low.degree)
    return found, ~found.usable | ((left <= REMAINDER) & (step < tolerance))


def _near_sums(rows: DataFrame, sites: DataFrame, r: float, middle: np.ndarray, buckets: int) -> DataFrame:
    """bucket, x, y and the sums (packed) over the rows at most r from a place; a place may come in several parts.

    Rows are copied to the 3 x 3 cells around them. Crowded cells are dealt into groups: each of some places meets each of some rows.
    """
    k = len(middle)
    low, zs = _terms(k)[1], [f"z{i}" for i in range(k - 1)]
    width = 2 * k - 1 + len(low.names)
    here, around = cells(sites, r, False), cells(rows.select("x", "y", "target", *(F.get("z", F.lit(i)).alias(f"z{i}") for i in range(k - 1))), r, True)
    own = here.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / SITES).cast("int").alias("_na"))
    met = cells(rows.groupBy("x", "y").agg(F.count("*").alias("_n")), r, True).groupBy("_cx", "_cy").agg(F.ceil(F.sum("_n") / ROWS).cast("int").alias("_nb"))
    dealt = own.join(met, ["_cx", "_cy"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.hash("x", "y", *(zs if n == "_nb" else [])), F.col(n))
    a = here.join(dealt, ["_cx", "_cy"]).withColumn("_a", some("_na")).withColumn("_b", every("_nb")).select("_cx", "_cy", "_a", "_b", "x", "y")
    b = around.join(dealt, ["_cx", "_cy"]).withColumn("_b", some("_nb")).withColumn("_a", every("_na")).select("_cx", "_cy", "_a", "_b", "x", "y", "target", *zs)

    def measured(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        ax, ay = ours["x"].to_numpy(), ours["y"].to_numpy()
        total = np.zeros((len(ours), 2, width))
        for at in range(0, len(theirs), SLICE):
            some = theirs.iloc[at : at + SLICE]
            dx, dy = ax[:, None] - some["x"].to_numpy(), ay[:, None] - some["y"].to_numpy()
            near, of = (dx * dx + dy * dy <= r * r).astype(float), some["target"].to_numpy()
            each = _parts(np.column_stack([some[zs].to_numpy(), np.ones(len(some))]), middle, low).T
            for y in (0, 1):
                total[:, y] += near[:, of == y] @ each[of == y]
        return pd.DataFrame({"x": ax, "y": ay, "data": [row.tobytes() for row in total]})

    by = ["_cx", "_cy", "_a", "_b"]
    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(measured, "x double, y double, data binary")
    # Rows without a place leave nothing out; they share a site.
    nowhere = rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(bytearray(16 * width)).alias("data"))
    return found.unionByName(nowhere).withColumn("bucket", F.pmod(F.hash("x", "y"), F.lit(buckets)))


def site_models(rows: DataFrame, r: float, c: float = 1.0, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """x, y, raw (coefficients over z, the intercept last), usable (both classes are left to train on), ok: for each distinct place, and once for none.

    rows: x and y (null without a place), z (features near standard scores, an array) and target.
    """
    d = len(rows.select("z").first()["z"])
    whole = fit_all(rows, d, c, rounds)
    middle = whole.raw()[0]
    wide, _ = _terms(d + 1)

    def parts(b: pa.RecordBatch, first: int, last: int) -> np.ndarray:
        x, y = inputs(b, d)
        return (_parts(x, middle, wide) @ np.column_stack([y == 0, y == 1])).T.reshape(1, -1)

    total = by_block(rows, ["z", "target"], 1, 2 * (2 * d + 1 + len(wide.names)), parts)[0]
    ends = rows.agg(*(F.max(F.abs(F.get("z", F.lit(i)))).alias(f"e{i}") for i in range(d))).first()
    reach = np.array([ends[f"e{i}"] for i in range(d)] + [1.0])
    there = placed(rows)
    sites = saved(there.select("x", "y").distinct())
    buckets = sites.count() // SOLVED + 1

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        number = parts.groupby(["x", "y"], dropna=False, sort=False).ngroup().to_numpy()
        near = np.zeros((number.max() + 1, len(parts["data"].iloc[0]) // 8))
        for i, data in zip(number, parts["data"], strict=True):
            near[i] += np.frombuffer(data, "<f8")
        found, ok = _fits(total, near, middle, reach, c, rounds, tolerance)
        place = parts.iloc[np.unique(number, return_index=True)[1]]
        return pd.DataFrame({"x": place["x"].to_numpy(), "y": place["y"].to_numpy(), "raw": list(found.raw()), "usable": found.usable, "ok": ok})

    sums = _near_sums(there, sites, r, middle, buckets).groupBy("bucket").applyInPandas(solve, "x double, y double, raw array<double>, usable boolean, ok boolean")
    # In pandas a missing place is NaN.
    return saved(sums.withColumns({c_: F.nanvl(c_, F.lit(None).cast("double")) for c_ in "xy"}))
