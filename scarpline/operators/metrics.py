"""Classification metrics from tables of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.operators.select import score_ranges


def confusion(df: DataFrame, predicted: Column, target: str = "target") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    p, t = predicted.cast("int"), F.col(target)
    cell = lambda a, b: F.count_if((t == a) & (p == b))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def class_metrics(df: DataFrame, predicted: Column, target: str = "target") -> DataFrame:
    """One row: accuracy, precision, recall, f1; a division by 0 gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    found = confusion(df, predicted, target)
    return found.select(ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_score(df: DataFrame, score: str, target: str) -> DataFrame:
    """score, pos, neg and both summed over all higher scores; no task gets all scores."""
    rows = score_ranges(df, score, pos=F.count_if(F.col(target) == 1), neg=F.count_if(F.col(target) == 0))
    totals = rows.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = lambda n, all_: (F.col(all_) - F.col(f"{n}_below") - F.col(n)).alias(f"{n}_above")
    return rows.crossJoin(F.broadcast(totals)).select("score", "pos", "neg", above("pos", "_p"), above("neg", "_n"))


def auc(df: DataFrame, score: str, target: str = "target") -> DataFrame:
    """One row, ``auc``: exact, ties count half; null if a class is missing."""
    rows = _by_score(df, score, target)
    won = F.sum(F.col("neg") * F.col("pos_above") + F.col("neg") * F.col("pos") / 2)
    return rows.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, score: str, target: str = "target") -> DataFrame:
    """threshold, tpr, fpr for each distinct score."""
    rows = _by_score(df, score, target)
    totals = rows.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return rows.crossJoin(F.broadcast(totals)).select(F.col("score").alias("threshold"), F.try_divide(F.col("pos_above") + F.col("pos"), F.col("_p")).alias("tpr"), F.try_divide(F.col("neg_above") + F.col("neg"), F.col("_n")).alias("fpr"))


def fold_summary(folds: DataFrame, value: str = "auc") -> DataFrame:
    """mean and sample deviation over folds."""
    return folds.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("folds"))


def long_metrics(metrics: DataFrame, run_id: str, model: str, scheme: str, fold: Column | None = None) -> DataFrame:
    """The rows of a report: run_id, model, scheme, fold, metric, value."""
    values = metrics.select((F.lit(None).cast("int") if fold is None else fold).alias("fold"), *(F.col(c).cast("double").alias(c) for c in metrics.columns if c != "fold"))
    rows = values.unpivot(["fold"], [c for c in values.columns if c != "fold"], "metric", "value")
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), F.lit(scheme).alias("scheme"), "fold", "metric", "value")
