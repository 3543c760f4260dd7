"""Logistic fits for many folds at once: what cross-validation with as many folds as rows needs.

A fold's rows are all but those near it. Counts, means and deviations of every fold are the totals minus those of the rows left out, in
one job. Then each Newton step is one job too: a task takes its rows against the coefficients of all folds, as a product of matrices, and
the sums that a fold's left-out rows would add are taken off. Folds start from the fit on all rows, so few steps are needed. Rows are
read once a step, whatever the number of folds; what is shuffled and broadcast are some numbers for each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from scarpline.sources.tables import saved

#: Folds whose sums are sent as one, rows that a task takes at once, and groups of tasks whose sums are added first.
BLOCK, SLICE, LANES = 500, 2000, 128


@dataclass(frozen=True)
class Folds:
    """For each fold (by position): rows of both classes, means and sample deviations of the features, coefficients over standard scores (the intercept last)."""

    names: np.ndarray
    counts: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    fitted: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        return (self.counts > 0).all(axis=1)

    def raw(self) -> np.ndarray:
        """Coefficients over the features themselves, the intercept last; a constant feature has none."""
        scaled = self.fitted[:, :-1] * _inverse(self.sd)
        return np.column_stack([scaled, self.fitted[:, -1] - (scaled * self.mean).sum(axis=1)])


def _inverse(sd: np.ndarray) -> np.ndarray:
    return np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)


def _added(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of the tasks' numbers for each block of folds (a matrix of ``width`` columns, packed)."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, "<f8") for d in rows["data"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [total.tobytes()]})

    # Two rounds, so that no task gets the sums of all tasks of a block.
    some = parts.groupBy("block", "lane").applyInPandas(add, "block int, data binary")
    found = some.groupBy("block").applyInPandas(add, "block int, data binary").collect()
    return {r["block"]: np.frombuffer(r["data"], "<f8").reshape(-1, width) for r in found}


def by_block(rows: DataFrame, columns: Sequence[str], n: int, width: int, work) -> np.ndarray:
    """folds x width sums over all rows of ``work(slice of a batch, first fold, last fold)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lane = np.zeros((n, width)), 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                lane = part.column(0)[0].as_py()
                for first in range(0, n, BLOCK):
                    total[first : first + BLOCK] += work(part, first, min(first + BLOCK, n))
        for first in range(0, n, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([first // BLOCK], pa.int32()), pa.array([lane % LANES], pa.int32()), pa.array([total[first : first + BLOCK].tobytes()], pa.binary())], ["block", "lane", "data"])

    parts = rows.select(F.spark_partition_id().alias("lane"), *columns).mapInArrow(run, "block int, lane int, data binary")
    found = _added(parts, width)
    return np.vstack([found[k] for k in sorted(found)]) if found else np.zeros((n, width))


def inputs(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Features with a one behind them, and targets, of a slice (lane, features, target, ...)."""
    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.column_stack([x, np.ones(len(x))]), b.column(2).to_numpy(zero_copy_only=False).astype(float)


def _left_out(b: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    """rows x folds: 0 where the row is left out of the fold, 1 else."""
    lists = b.column(3)
    at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    fold = lists.flatten().to_numpy()
    inside = (fold >= first) & (fold < last)
    kept = np.ones((len(lists), last - first))
    kept[at[inside], fold[inside] - first] = 0.0
    return kept


def _moments(rows: DataFrame, n: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts (folds x classes), means and sample deviations: totals minus what is left out."""
    width = 2 + 2 * d

    def sums(b: pa.RecordBatch, first: int, last: int) -> np.ndarray:
        x, y = inputs(b, d)
        each = np.column_stack([1 - y, y, x[:, :-1], x[:, :-1] ** 2])
        return each.sum(axis=0) - (1 - _left_out(b, first, last)).T @ each

    total = by_block(rows, ["x", "target", "left_out"], n, width, sums)
    return moments_of(np.rint(total[:, :2]), total[:, 2 : 2 + d], total[:, 2 + d :])


def moments_of(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same counts, means and sample deviations, of sums over the rows of each fold."""
    size = np.maximum(counts.sum(axis=1), 1)[:, None]
    mean = sums / size
    variance = (squares - size * mean**2) / np.maximum(size - 1, 1)
    return counts, mean, np.sqrt(np.where(variance > 1e-12, variance, 0.0))


def solved(found: Folds, sums: Callable[[np.ndarray], np.ndarray], c: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients after Newton steps on the penalised loss, and the largest number of each fold's last step.

    sums: of the raw coefficients, the loss's gradient and the upper half of its second derivatives over the features, of each fold.
    """
    n, d = found.mean.shape
    beta, usable, k = found.fitted.copy(), found.usable, d + 1
    inverse = _inverse(found.sd)
    upper = np.triu_indices(k)
    turn = np.zeros((n, k, k))  # from coefficients of standard scores to those of the features
    turn[:, np.arange(d), np.arange(d)], turn[:, -1, :-1], turn[:, -1, -1] = inverse, -inverse * found.mean, 1.0
    ridge, last = np.append(np.full(d, 1 / c), 0.0), np.zeros(n)
    for _ in range(rounds):
        total = sums(Folds(found.names, found.counts, found.mean, found.sd, beta).raw())
        hessian = np.zeros((n, k, k))
        hessian[:, upper[0], upper[1]] = total[:, k:]
        hessian[:, upper[1], upper[0]] = total[:, k:]
        gradient = np.einsum("fij,fi->fj", turn, total[:, :k]) + ridge * beta
        hessian = np.einsum("fji,fjk,fkl->fil", turn, hessian, turn) + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        step *= np.minimum(1, 5 / np.maximum(np.linalg.norm(step, axis=1), 1e-300))[:, None]
        beta[usable] -= step[usable]
        last = np.abs(step).max(axis=1)
        if not usable.any() or last[usable].max() < tolerance:
            break
    return beta, last


def _steps(rows: DataFrame, found: Folds, c: float, rounds: int, tolerance: float) -> np.ndarray:
    """Coefficients after Newton steps on the penalised loss, with balanced classes; a step is one job."""
    n, d = found.mean.shape
    k, size, upper = d + 1, found.counts.sum(axis=1), np.triu_indices(d + 1)
    weight = np.divide(size[:, None], 2 * found.counts, out=np.zeros_like(found.counts), where=found.counts > 0)

    def over_rows(raw: np.ndarray) -> np.ndarray:
        def sums(b: pa.RecordBatch, first: int, last: int) -> np.ndarray:
            x, y = inputs(b, d)
            p = 1 / (1 + np.exp(-np.clip(x @ raw[first:last].T, -500, 500)))
            w = _left_out(b, first, last) * weight[first:last].T[y.astype(int)]
            return np.column_stack([(w * (p - y[:, None])).T @ x, (w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])])

        return by_block(rows, ["x", "target", "left_out"], n, k + len(upper[0]), sums)

    return solved(found, over_rows, c, rounds, tolerance)[0]


def fit_all(rows: DataFrame, d: int, c: float = 1.0, rounds: int = 30) -> Folds:
    """The fit on all rows of z and target, as one fold that leaves nothing out."""
    every = rows.select(F.col("z").alias("x"), "target", F.array().cast("array<int>").alias("left_out"))
    whole = Folds(np.array([None]), *_moments(every, 1, d), np.zeros((1, d + 1)))
    return Folds(whole.names, whole.counts, whole.mean, whole.sd, _steps(every, whole, c, rounds, 1e-6))


def standard(df: DataFrame, features: Sequence[str]) -> Column:
    """The features as an array of numbers of one size near 0, which lose no digits in sums."""
    middle = df.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    centre, spread = ([middle[f"{p}{i}"] or 0.0 for i in range(len(features))] for p in "ms")
    return F.array(*((F.col(f).cast("double") - m) / (s or 1.0) for f, m, s in zip(features, centre, spread, strict=True)))


def fit_folds(df: DataFrame, features: Sequence[str], left_out: DataFrame, key: str, c: float = 1.0, rounds: int = 30, tolerance: float = 1e-9) -> tuple[Folds, DataFrame]:
    """The fits of all folds, and the rows (key, x, target, fold, left_out) that they were made of.

    df: key, features, target and fold. left_out: key and ``excluded``, the folds that a row must not train for. The numbers of
    all folds' coefficients are held by the driver and sent to each task; fold names are of any type that sorts; a row may have none.
    """
    spark, d = df.sparkSession, len(features)
    names = sorted(r["fold"] for r in df.select("fold").where("fold is not null").distinct().collect())  # a name and some numbers for each fold
    number = spark.createDataFrame([(f, i) for i, f in enumerate(names)], df.select("fold").schema.add("at", IntegerType()))
    x = standard(df, features)
    pairs = left_out.select(key, F.explode("excluded").alias("fold")).join(F.broadcast(number), "fold").groupBy(key).agg(F.collect_list("at").alias("left_out"))
    rows = df.select(key, x.alias("x"), "target", "fold").join(pairs, key, "left").join(F.broadcast(number), "fold", "left")
    rows = saved(rows.select(key, "x", "target", "fold", F.coalesce("left_out", F.array().cast("array<int>")).alias("left_out"), "at"))
    first = fit_all(rows.select(F.col("x").alias("z"), "target"), d, c, rounds).raw()[0]
    counts, mean, sd = _moments(rows, len(names), d)
    found = Folds(np.array(names), counts, mean, sd, np.zeros((len(names), d + 1)))
    begin = np.column_stack([first[:-1] * sd, first[-1] + mean @ first[:-1]])  # the same plane, in each fold's own scores
    found = Folds(found.names, counts, mean, sd, np.where(found.usable[:, None], begin, 0.0))
    return Folds(found.names, counts, mean, sd, _steps(rows, found, c, rounds, tolerance)), rows


def fold_predictions(found: Folds, rows: DataFrame, key: str) -> DataFrame:
    """key, target, fold, p of each row by its own fold's fit; folds with one class to train on have none."""
    raw, usable = found.raw(), found.usable
    schema = rows.select(key, "target", "fold").schema.add("p", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = inputs(pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], ["a", "b", "c"]), raw.shape[1] - 1)
            at = b.column(4).to_numpy()
            p = 1 / (1 + np.exp(-np.clip((x * raw[at]).sum(axis=1), -500, 500)))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(p)], schema.fieldNames())
            yield out.filter(pa.array(usable[at]))

    return rows.select(key, "x", "target", "fold", "at").mapInArrow(run, schema)
