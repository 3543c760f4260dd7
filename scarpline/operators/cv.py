"""Cross-validation by any fold column, with or without a buffer around the test rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.expansion import site_models
from scarpline.operators.metrics import auc
from scarpline.operators.models import fit, scores
from scarpline.operators.newton import fit_folds, fold_predictions, standard
from scarpline.operators.sampling import stratified_folds
from scarpline.operators.spatial import has_place, near_labels
from scarpline.sources.tables import saved

Maker = Callable[[DataFrame], Estimator]


def excluded_folds(df: DataFrame, key: str, r: float) -> DataFrame:
    """key, excluded: the folds that a row must not train for, as it is within r of one of their rows (its own among them); rows without a place have none.

    Rows of a place share its folds, which come from cells (``spatial.near_labels``) where they can.
    """
    sets = near_labels(df, "fold", r).groupBy("x", "y").agg(F.collect_set("fold").alias("excluded"))
    return df.select(key, "x", "y").join(sets, ["x", "y"]).select(key, "excluded")


def with_excluded(df: DataFrame, key: str, r: float) -> DataFrame:
    """Rows of a place with ``excluded``, written once for all models that ``buffered_cv`` is to try."""
    return saved(df.join(excluded_folds(df, key, r), key))


def fold_membership(df: DataFrame, key: str, r: float) -> DataFrame:
    """fold, n_test, n_train for folds with a buffer; no complement is built, what is excluded is subtracted."""
    rows = df.groupBy("x", "y").agg(F.count_distinct(key).alias("_rows"))
    out = near_labels(df, "fold", r).join(rows, ["x", "y"]).groupBy("fold").agg(F.sum("_rows").alias("_out"))
    tests = df.groupBy("fold").agg(F.count("*").alias("n_test"))
    total = df.agg(F.count("*").alias("_n"))
    return tests.join(out, "fold").crossJoin(F.broadcast(total)).select("fold", "n_test", (F.col("_n") - F.col("_out")).alias("n_train"))


def stratified_predictions(df: DataFrame, key: str, features: Sequence[str], make: Maker, k: int = 5, seed: int = 42, balance: str = "classes") -> DataFrame:
    """key, target, fold, p: each row by the model of the other folds, which is scaled and weighted by its own training rows."""
    rows = saved(stratified_folds(df, key, k, seed))
    parts = [scores(fit(rows.where(F.col("fold") != f), features, make, balance), rows.where(F.col("fold") == f)).select(key, "target", "fold", "p") for f in range(k)]
    return saved(reduce(DataFrame.unionByName, parts))


def fold_aucs(predictions: DataFrame, k: int) -> DataFrame:
    """fold and auc; null for a fold with one class, which means and deviations leave out (``folds`` counts the others)."""
    found = [(f, auc(predictions.where(F.col("fold") == f), "p").first()["auc"]) for f in range(k)]
    return predictions.sparkSession.createDataFrame(found, "fold int, auc double")  # k rows


def stratified_cv(df: DataFrame, key: str, features: Sequence[str], make: Maker, k: int = 5, seed: int = 42, balance: str = "classes") -> DataFrame:
    """fold and auc of k models."""
    return fold_aucs(stratified_predictions(df, key, features, make, k, seed, balance), k)


def buffered_cv(df: DataFrame, key: str, features: Sequence[str], make: Maker, r: float, folds: Sequence[int] | None = None, max_folds: int = 200, balance: str = "classes") -> DataFrame:
    """key, target, fold, p: predictions for held-out rows by models that saw nothing within r of their fold.

    df has ``fold``, and ``excluded`` if ``with_excluded`` has been called for it; with squares as folds it takes as many fits as folds. Folds left with one class are skipped; if all are, no
    row comes back and the score is null. ``pooled_auc`` of the result is the score. More than ``max_folds`` folds are refused:
    ``buffered_logistic`` takes any number.
    """
    names = sorted(r_["fold"] for r_ in df.select("fold").distinct().limit(max_folds + 1).collect()) if folds is None else list(folds)
    if len(names) > max_folds:
        raise ValueError(f"More than {max_folds} folds; deal squares to fewer folds, or raise max_folds")
    rows = df if "excluded" in df.columns else with_excluded(df, key, r)
    parts = [df.select(key, "target", "fold", F.lit(None).cast("double").alias("p")).limit(0)]
    for f in names:
        train = rows.where(~F.array_contains("excluded", F.lit(f)))
        if train.select("target").distinct().count() < 2:
            continue
        parts.append(scores(fit(train, features, make, balance), rows.where(F.col("fold") == f)).select(key, "target", "fold", "p"))
    return reduce(DataFrame.unionByName, parts)


def buffered_logistic(df: DataFrame, key: str, features: Sequence[str], r: float, c: float = 1.0) -> DataFrame:
    """``buffered_cv`` of logistic regression for any number of folds, all of them fitted together; with the row's key as fold it is leave-one-out.

    Keys must be unique. The fits are those of ``models.logistic_regression`` on standard scores and balanced classes, to the end.
    Folds of one place each are fitted by ``expansion``, which reads the rows some times in all; those that it can't fit, and folds of
    many places, by ``newton.fit_folds``, whose work is rows times folds.
    """
    if not _one_place(df):
        found, rows = fit_folds(df, features, excluded_folds(df, key, r), key, c)
        return fold_predictions(found, rows, key)
    somewhere = lambda c_: F.when(has_place(), F.col(c_)).alias(c_)
    rows = saved(df.select(key, "target", "fold", somewhere("x"), somewhere("y"), standard(df, features).alias("z")))
    fits = site_models(rows, r, c)
    score = F.aggregate(F.zip_with("raw", F.concat("z", F.array(F.lit(1.0))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    p = 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(500.0)), F.lit(-500.0))))
    same = rows["x"].eqNullSafe(fits["x"]) & rows["y"].eqNullSafe(fits["y"])
    held = rows.join(fits, same).where("usable and ok").select(key, "target", "fold", p.alias("p"))
    rest = saved(fits.where("not ok").select("x", "y", F.monotonically_increasing_id().alias("fold")))
    if rest.isEmpty():
        return held
    some = df.drop("fold").join(rest, ["x", "y"], "left")
    found, fitted = fit_folds(some, features, excluded_folds(some, key, r), key, c)
    more = fold_predictions(found, fitted.where("at is not null"), key).drop("fold").join(df.select(key, "fold"), key)
    return held.unionByName(more.select(*held.columns))


def _one_place(df: DataFrame) -> bool:
    """Whether each fold's rows are all at one place, or all without one."""
    ends = [f(F.when(has_place(), F.col(c))).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    folds = df.groupBy("fold").agg(F.count("*").alias("_n"), F.count_if(has_place()).alias("_m"), *ends)
    return folds.where("_m not in (0, _n) or low_x <> high_x or low_y <> high_y").isEmpty()


def pooled_auc(predictions: DataFrame) -> DataFrame:
    """One row, ``auc``, over all held-out rows; null if a class, or every row, is missing."""
    return auc(predictions, "p")
