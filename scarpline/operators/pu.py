"""Positive-unlabeled bagging: models of all positives against draws of unlabeled rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.models import fit, reseeded, scores
from scarpline.operators.sampling import bag_draws
from scarpline.operators.scaling import scaled
from scarpline.operators.select import bottom_fraction
from scarpline.sources.tables import saved


@dataclass(frozen=True)
class BaggedModel:
    """The models of the bags; scores are means over them."""

    models: tuple[PipelineModel, ...]

    def scores(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Rows with the mean probability; all models look at a row in one pass."""
        columns = df.columns
        for i, m in enumerate(self.models):
            df = scores(m, df, f"_p{i}")
        total = sum((F.col(f"_p{i}") for i in range(1, len(self.models))), F.col("_p0"))
        return df.select(*columns, (total / len(self.models)).alias(name))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.scores(df).withColumn("predicted", (F.col("p") >= threshold).cast("int"))


def bagged(df: DataFrame, key: str, features: Sequence[str], make: Callable[[DataFrame], Estimator], bags: int = 10, ratio: float = 1.0, seed: int = 42) -> BaggedModel:
    """Fit a model for each bag, by rows and an estimator's seed of its own. An error if there are no positives or no unlabeled rows."""
    counts = df.agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("free")).first()
    if not counts["pos"] or not counts["free"]:
        raise ValueError("Bagging takes at least one positive and one unlabeled row")
    drawn = bag_draws(df, key, bags, seed, ratio).persist()
    positive, models = df.where("target = 1").persist(), []
    for b in range(bags):
        rows = positive.unionByName(df.join(drawn.where(F.col("bag") == b).select(key), key, "left_semi").select(*df.columns))
        models.append(fit(rows, features, reseeded(make, seed + b + 1)))
    drawn.unpersist()
    positive.unpersist()
    return BaggedModel(tuple(models))


def refine(df: DataFrame, key: str, features: Sequence[str], make: Callable[[DataFrame], Estimator], keep_fraction: float = 0.5, **options) -> DataFrame:
    """All positives, and of the unlabeled rows the fraction that looks least like them. A table without unlabeled rows stays as it is.

    Bags are drawn from features in standard scores over all rows.
    """
    free = df.where("target = 0")
    if free.isEmpty():
        return df
    whole = saved(scaled(df, features))
    scored = bagged(whole, key, features, make, **options).scores(whole.where("target = 0"))
    kept = bottom_fraction(saved(scored.select(key, "p")), "p", key, keep_fraction).select(key)
    return df.where("target = 1").unionByName(free.join(kept, key, "left_semi").select(*df.columns))
