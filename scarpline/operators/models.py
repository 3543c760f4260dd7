"""Estimators of MLlib with the parameters of the study, scores and importances."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators.scaling import positive_weight, weighted

#: Rows of a task in a fit, about; smaller tables stay as they are.
TASK_ROWS = 100_000
_COLUMNS = {"featuresCol": "scaled", "labelCol": "target", "weightCol": "weight"}


def random_forest(trees: int = 200, depth: int = 30, seed: int = 42) -> Estimator:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, **_COLUMNS)


def logistic_regression(weight_sum: float, c: float = 1.0, rounds: int = 1000) -> Estimator:
    """L2 with inverse strength c; MLlib averages the loss over the weights, so their sum turns c into its parameter."""
    return LogisticRegression(regParam=1.0 / (c * weight_sum), elasticNetParam=0.0, standardization=False, maxIter=rounds, **_COLUMNS)


def boosted_trees(rounds: int = 200, depth: int = 4, seed: int = 42) -> Estimator:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed, **_COLUMNS)


def decision_tree(depth: int = 30, seed: int = 42) -> Estimator:
    return DecisionTreeClassifier(maxDepth=depth, seed=seed, **_COLUMNS)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel: products of two rows' features are near ``exp(-gamma * |a - b|^2)``.

    ``size`` cosines of random planes, drawn by ``seed`` for rows of ``dims`` numbers. A row-wise expression, saved with its pipeline.
    """

    def __init__(self, inputCol: str = "scaled", outputCol: str = "kernel", dims: int = 1, size: int = 200, gamma: float = 1.0, seed: int = 42) -> None:
        super().__init__()
        for name, value, kind in (("dims", dims, TypeConverters.toInt), ("size", size, TypeConverters.toInt), ("gamma", gamma, TypeConverters.toFloat), ("seed", seed, TypeConverters.toInt)):
            setattr(self, name, Param(self, name, name, kind))
            self._paramMap[getattr(self, name)] = kind(value)
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        value = lambda name: self.getOrDefault(self.getParam(name))
        dice, n, wide = random.Random(value("seed")), value("size"), math.sqrt(2 * value("gamma"))
        planes = F.lit([[dice.gauss(0, wide) for _ in range(value("dims"))] + [dice.uniform(0, 2 * math.pi)] for _ in range(n)]).cast("array<array<double>>")
        row = F.concat(vector_to_array(self.getInputCol()), F.array(F.lit(1.0)))
        inner = lambda plane: F.aggregate(F.zip_with(plane, row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.transform(planes, lambda p: F.cos(inner(p)) * math.sqrt(2 / n))))


def kernel_svm(dims: int, rounds: int = 100, size: int = 200, gamma: float | None = None, seed: int = 42) -> Estimator:
    """A machine with a Gaussian kernel, by random Fourier features and a linear machine; gamma is 1 / dims over standard scores, if not given."""
    features = FourierFeatures(dims=dims, size=size, gamma=1 / dims if gamma is None else gamma, seed=seed)
    return Pipeline(stages=[features, LinearSVC(maxIter=rounds, **{**_COLUMNS, "featuresCol": "kernel"})])


def linear_svm(rounds: int = 100) -> Estimator:
    return LinearSVC(maxIter=rounds, **_COLUMNS)


def factory(name: str, seed: int = 42, **options) -> Callable[[DataFrame], Estimator]:
    """A function from training rows to an unfitted estimator: rf, lr, gbt, cart, svm (linear) or rbf (a machine with a Gaussian kernel)."""
    if name == "lr":
        return lambda df: logistic_regression(max(1.0, float(df.count())), **options)  # balanced weights sum to the rows
    makers = {"rf": random_forest, "gbt": boosted_trees, "cart": decision_tree}
    if name == "svm":
        return lambda df: linear_svm(**options)
    if name == "rbf":
        return lambda df: kernel_svm(len(df.columns) - 2, seed=seed, **options)  # all but target and weight are features
    if name not in makers:
        raise ValueError(f"Unknown model: {name}")
    return lambda df: makers[name](seed=seed, **options)


def reseeded(make: Callable[[DataFrame], Estimator], seed: int) -> Callable[[DataFrame], Estimator]:
    """The same estimators with another seed, where they have one."""

    def other(df: DataFrame) -> Estimator:
        made = make(df)
        return made.copy({made.getParam("seed"): seed}) if made.hasParam("seed") else made

    return other


def shared_out(rows: DataFrame) -> DataFrame:
    """The same rows in parts of some TASK_ROWS, in an order of their own, so that no task of a fit holds more, however few files the table has."""
    parts = rows.count() // TASK_ROWS + 1
    return rows if parts == 1 else rows.repartition(parts).sortWithinPartitions(*rows.columns)


def fit(df: DataFrame, features: Sequence[str], make: Callable[[DataFrame], Estimator], balance: str = "classes") -> PipelineModel:
    """Fit assembler, scaler and estimator on rows of features and target. balance: weights by ``classes``, or ``positives`` for boosting.

    The scaler is part of the model, so a fold is scaled by its own training rows.
    """
    rows = df.select(*features, "target")
    if balance == "classes":
        rows = weighted(rows)
    else:
        scale = F.when(F.col("target") == 1, F.col("scale_pos_weight")).otherwise(F.lit(1.0))
        rows = rows.crossJoin(F.broadcast(positive_weight(rows))).withColumn("weight", scale).drop("scale_pos_weight")
    rows = shared_out(rows).persist()
    try:
        stages = [VectorAssembler(inputCols=list(features), outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), make(rows)]
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def train(df: DataFrame, features: Sequence[str], name: str, seed: int = 42, **options) -> PipelineModel:
    return fit(df, features, factory(name, seed, **options), "positives" if name == "gbt" else "classes")


def scores(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Rows with the probability of class 1; for a model without probabilities, the margin."""
    out = model.transform(df)
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn(name, vector_to_array(raw)[1]).select(*df.columns, name)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """feature, importance, sd over trees, rank from 1; as many rows as features. A linear model's importances are its coefficients' sizes (of scaled features), as shares."""
    from pyspark.sql import SparkSession

    fitted = model.stages[-1]
    if isinstance(fitted, PipelineModel):
        raise ValueError("A kernel machine has no importances")
    if hasattr(fitted, "featureImportances"):
        mean = fitted.featureImportances.toArray()
        trees = [t.featureImportances.toArray() for t in getattr(fitted, "trees", [])] or [mean]
    else:
        size = abs(fitted.coefficients.toArray())
        mean = size / (size.sum() or 1.0)
        trees = [mean]
    rows = [(c, float(mean[i]), float((sum((t[i] - sum(u[i] for u in trees) / len(trees)) ** 2 for t in trees) / len(trees)) ** 0.5), i) for i, c in enumerate(features)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double, sd double, ordinal int")
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "ordinal"))).drop("ordinal")
