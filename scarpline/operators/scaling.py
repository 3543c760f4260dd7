"""Class weights, standard scores and correlations, each from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.functions.scalars import z_score


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """target, n and weight: all rows over classes times rows of the class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    return counts.crossJoin(F.broadcast(totals)).select(target, "n", (F.col("_all") / (F.col("_classes") * F.col("n"))).alias("weight"))


def weighted(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows with the weight of their class."""
    return df.join(F.broadcast(class_weights(df, target).drop("n")), target).select(*df.columns, "weight")


def positive_weight(df: DataFrame, target: str = "target") -> DataFrame:
    """One row, ``scale_pos_weight``: negatives over positives, each counted as one at least."""
    pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    return df.agg((F.greatest(neg, F.lit(1)) / F.greatest(pos, F.lit(1))).alias("scale_pos_weight"))


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, sd (population); a constant feature, by its least and most value, has sd 0."""
    rows = df.select(*features).unpivot([], list(features), "feature", "value")
    found = rows.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    return found.select("feature", "mean", F.when(F.col("_low") == F.col("_high"), F.lit(0.0)).otherwise(F.col("sd")).alias("sd"))


def scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with standard scores in place of the features."""
    ends = {c: (F.min(c), F.max(c)) for c in features}
    stats = df.agg(*(F.avg(c).alias(f"_mean_{c}") for c in features), *(F.when(a == b, F.lit(0.0)).otherwise(F.stddev_pop(c)).alias(f"_sd_{c}") for c, (a, b) in ends.items()))
    rows = df.crossJoin(F.broadcast(stats))
    return rows.withColumns({c: z_score(c, F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in features}).select(*df.columns)


def pearson(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """a, b, r for each pair of features in their order; a constant feature correlates 0. One aggregate for all pairs."""
    pairs = list(combinations(features, 2))
    sums = [(F.covar_pop(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    own = [x for c in features for x in (F.stddev_pop(c).alias(f"s_{c}"), (F.min(c) == F.max(c)).alias(f"k_{c}"))]
    row = df.agg(*sums, *own)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"k_{a}") | F.col(f"k_{b}"), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col(f"c{i}"), F.col(f"s_{a}") * F.col(f"s_{b}")), F.lit(0.0))).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("p")).select("p.a", "p.b", "p.r")


def correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.85) -> tuple[list[str], list[str]]:
    """Kept and dropped features: along the pairs in order, the later one goes if the earlier one is kept and they correlate so much."""
    found = {(r["a"], r["b"]): r["r"] for r in pearson(df, features).collect()} if len(features) > 1 else {}
    dropped: list[str] = []
    for a, b in combinations(features, 2):
        if a not in dropped and b not in dropped and abs(found[a, b]) >= threshold:
            dropped.append(b)
    return [c for c in features if c not in dropped], dropped
