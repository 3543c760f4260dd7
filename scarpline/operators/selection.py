"""Choice of features: correlated ones go, a tree ranks, a genetic search looks for a good subset."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.functions.scalars import portable_hash
from scarpline.operators.metrics import auc
from scarpline.operators.models import factory, fit, importances, scores
from scarpline.operators.sampling import stratified_folds
from scarpline.operators.scaling import correlated
from scarpline.operators.select import threshold_select

Mask = tuple[bool, ...]


@dataclass(frozen=True)
class Selection:
    """The features chosen, those dropped, their ranking by a tree, and the fitness of a search."""

    chosen: list[str]
    dropped: list[str] = field(default_factory=list)
    ranking: list[tuple[str, float]] = field(default_factory=list)
    fitness: float | None = None


def ranked(df: DataFrame, features: Sequence[str], seed: int = 42) -> list[tuple[str, float]]:
    """(feature, importance) of one tree, best first."""
    table = importances(fit(df, features, factory("cart", seed)), features)
    return [(r["feature"], r["importance"]) for r in table.orderBy("rank").collect()]  # one row a feature


class _Fitness:
    """1 - mean AUC over folds, plus a hundredth for each feature; every mask is tried once."""

    def __init__(self, df: DataFrame, key: str, features: Sequence[str], make: Callable[[DataFrame], Estimator], folds: int, seed: int) -> None:
        counts = df.agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg")).first()
        self.features, self.make = list(features), make
        self.folds = min(folds, counts["pos"], counts["neg"] or 1)
        self.rows = stratified_folds(df, key, max(1, self.folds), seed).persist()
        self.known: dict[Mask, float] = {}

    def _tried(self, mask: Mask) -> float:
        chosen = [c for c, on in zip(self.features, mask, strict=True) if on]
        if not chosen or self.folds < 2:
            return 1e6
        found = []
        for f in range(self.folds):
            try:
                model = fit(self.rows.where(F.col("fold") != f), chosen, self.make)
            except IllegalArgumentException:  # the learner refuses this subset: as bad as can be; all other errors end the search
                return 1.0 + len(chosen) / 100
            found.append(auc(scores(model, self.rows.where(F.col("fold") == f)), "p").first()["auc"])
        return 1 - sum(found) / len(found) + len(chosen) / 100

    def close(self) -> None:
        self.rows.unpersist()

    def of(self, masks: Sequence[Mask], threads: int) -> list[float]:
        new = [m for m in dict.fromkeys(masks) if m not in self.known]
        with ThreadPoolExecutor(threads) as pool:
            self.known.update(zip(new, pool.map(self._tried, new), strict=True))
        return [self.known[m] for m in masks]


def _kernel_scores(x: np.ndarray, y: np.ndarray, held: np.ndarray, size: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Scores of the held-out rows by a penalised logistic fit on random features of a Gaussian kernel over the other rows' standard scores."""
    seen = ~held
    mean, sd = x[seen].mean(axis=0), x[seen].std(axis=0)
    z = (x - mean) / np.where(sd > 0, sd, 1.0)
    dice, d = np.random.default_rng(seed), x.shape[1]
    plane = np.cos(z @ dice.normal(0, math.sqrt(2 / d), (d, size)) + dice.uniform(0, 2 * math.pi, size)) * math.sqrt(2 / size)
    a, t = np.column_stack([plane, np.ones(len(x))]), y[seen]
    w = len(t) / (2 * np.bincount(t, minlength=2)[t])
    beta, ridge = np.zeros(size + 1), np.append(np.ones(size), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a[seen] @ beta, -30, 30)))
        beta -= np.linalg.solve((a[seen] * (w * p * (1 - p))[:, None]).T @ a[seen] + np.diag(ridge), a[seen].T @ (w * (p - t)) + ridge * beta)
    return a[held] @ beta


def _auc_of(score: np.ndarray, y: np.ndarray) -> float:
    """Exact, ties count half."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = (np.bincount(at[y == c], minlength=len(values)) for c in (1, 0))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


class _KernelFitness:
    """``_Fitness`` of a kernel machine, with all new masks of a generation scored in one job.

    It works on a sample of labelled rows: the ``sample`` ones of the smallest hash, shared by the classes as in the table. They are sent to the
    tasks once; each mask and fold is a row of the job. The tasks' errors end the search.
    """

    def __init__(self, df: DataFrame, key: str, features: Sequence[str], folds: int, seed: int, sample: int = 20_000, size: int = 100) -> None:
        self.spark, self.features, self.seed, self.size = df.sparkSession, list(features), seed, size
        counts = df.groupBy("target").agg(F.count("*").alias("n"))
        share = df.agg(F.count("*").alias("all")).first()["all"] or 1
        wanted = counts.select("target", F.least("n", F.ceil(F.col("n") * min(1.0, sample / share))).cast("long").alias("k"))
        some = threshold_select(df, wanted, portable_hash(key, seed), [key], ["target"])
        rows = stratified_folds(some, key, folds, seed).select(*features, "target", "fold").collect()  # a bounded sample
        table = np.array([tuple(r) for r in rows], float).reshape(-1, len(self.features) + 2)
        by_class = np.bincount(table[:, -2].astype(int), minlength=2)
        self.folds = min(folds, *map(int, by_class)) if len(table) else 0
        order = table[:, -1].astype(int) % max(1, self.folds)
        self.table = self.spark.sparkContext.broadcast((table[:, :-2], table[:, -2].astype(int), order))
        self.known: dict[Mask, float] = {}

    def of(self, masks: Sequence[Mask], threads: int) -> list[float]:
        new = [m for m in dict.fromkeys(masks) if m not in self.known]
        self.known.update((m, 1e6) for m in new if not any(m) or self.folds < 2)
        open_ = [m for m in new if m not in self.known]
        if open_:
            table, size, seed = self.table, self.size, self.seed

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                x, y, fold = table.value
                for b in batches:
                    found = [_auc_of(_kernel_scores(x[:, list(on)], y, fold == f, size, seed), y[fold == f]) for on, f in zip(b["columns"], b["fold"], strict=True)]
                    yield pd.DataFrame({"mask": b["mask"], "auc": found})

            jobs = [(i, [j for j, on in enumerate(m) if on], f) for i, m in enumerate(open_) for f in range(self.folds)]
            wide = self.spark.createDataFrame(jobs, "mask int, columns array<int>, fold int").repartition(len(jobs))
            means = {r["mask"]: r["auc"] for r in wide.mapInPandas(run, "mask int, auc double").groupBy("mask").agg(F.avg("auc").alias("auc")).collect()}
            self.known.update((m, 1 - means[i] + sum(m) / 100) for i, m in enumerate(open_))
        return [self.known[m] for m in masks]

    def close(self) -> None:
        self.table.unpersist()


def genetic(df: DataFrame, key: str, features: Sequence[str], make: Callable[[DataFrame], Estimator] | None, population: int = 20, generations: int = 15, crossover: float = 0.7, mutation: float = 0.15, folds: int = 3, seed: int = 42, threads: int = 4) -> tuple[list[str], float]:
    """The best subset found and its fitness (lower is better). The driver holds masks; each fitness is Spark jobs of ``make``'s models, or,
    without it, a generation is one job of kernel machines on a sample of the rows."""
    n = len(features)
    if n < 2:
        return list(features), 1e6 if not n else 0.0
    dice, fitness = random.Random(seed), _Fitness(df, key, features, make, folds, seed) if make else _KernelFitness(df, key, features, folds, seed)

    def mended(bits: list[bool]) -> Mask:
        if not any(bits):
            bits[dice.randrange(n)] = True
        return tuple(bits)

    pool = [mended([dice.random() < 0.5 for _ in range(n)]) for _ in range(population)]
    best: tuple[float, Mask] = (float("inf"), pool[0])
    for _ in range(generations):
        order = sorted(zip(fitness.of(pool, threads), pool, strict=True))
        best = min(best, order[0])
        children = [m for _, m in order[: max(1, population // 5)]]
        while len(children) < population:
            a, b = (min(dice.sample(order, min(3, len(order))))[1] for _ in range(2))
            cut = dice.randrange(1, n) if dice.random() < crossover else n
            children.append(mended([bit != (dice.random() < mutation) for bit in a[:cut] + b[cut:]]))
        pool = children
    best = min(best, *zip(fitness.of(pool, threads), pool, strict=True))
    fitness.close()
    return [c for c, on in zip(features, best[1], strict=True) if on], best[0]


def choose(df: DataFrame, key: str, features: Sequence[str], method: str = "none", threshold: float = 0.85, model: str = "rf", seed: int = 42, **options) -> Selection:
    """none: all features. cart: without correlated ones, by importance. ga: a search among those, by forests (rf), boosted trees (gbt) or kernel machines (svm)."""
    if method == "none":
        return Selection(list(features))
    if method not in ("cart", "ga"):
        raise ValueError(f"Unknown method: {method}")
    kept, dropped = correlated(df, features, threshold)
    ranking = ranked(df, kept, seed)
    if method == "cart":
        return Selection([c for c, _ in ranking], dropped, ranking)
    makers = {"rf": factory("rf", seed, trees=50, depth=6), "gbt": factory("gbt", seed, rounds=50), "svm": None}
    chosen, fitness = genetic(df, key, kept, makers[model], seed=seed, **options)
    return Selection(chosen, dropped, ranking, fitness)
