"""Drawing rows: pseudo-absences, bags and folds, by seeded hashes of a stable key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.functions.scalars import portable_hash, uniform
from scarpline.operators.select import numbered, one_row, threshold_select
from scarpline.operators.spatial import away_from
from scarpline.sources.tables import saved


def first_by_hash(df: DataFrame, key: str, n: int, seed: int, exact: bool = True) -> DataFrame:
    """The n rows of the smallest hash of the key; an error if there are fewer and ``exact``."""
    if exact and (have := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows are wanted, {have} are there")
    return threshold_select(df, one_row(df, n), portable_hash(key, seed), [key])


def pseudo_absences(candidates: DataFrame, points: DataFrame, key: str, n: int, buffer: float, seed: int, exact: bool = True) -> DataFrame:
    """n candidates at least ``buffer`` from all points, by hash; all candidates are looked at. If there are fewer, an error says so, or, unless ``exact``, all of them are taken."""
    return first_by_hash(saved(away_from(candidates, points, buffer)), key, n, seed, exact)


def random_absences(points: DataFrame, features: Sequence[str], n: int, x: tuple[float, float], y: tuple[float, float], buffer: float, seed: int = 42, feature_range: tuple[float, float] = (0.0, 1.5), tries: int = 200) -> DataFrame:
    """Up to n random rows of target 0 in a box, at least ``buffer`` from all points, features uniform; at most ``tries`` times n are drawn.

    All numbers come from hashes of the draw's number and the seed, so every look at the rows sees the same ones.
    """
    spark, drawn = points.sparkSession, 0
    found, have, batch = None, 0, max(4 * n, 1)
    while have < n and drawn < tries * n:
        batch = min(batch, tries * n - drawn)
        within = lambda low, high, k: uniform("id", 1000 * seed + k) * (high - low) + low
        rows = spark.range(drawn, drawn + batch).select("id", within(*x, 1).alias("x"), within(*y, 2).alias("y"), *(within(*feature_range, 3 + i).alias(c) for i, c in enumerate(features)), F.lit(0).alias("target"))
        more = away_from(rows, points, buffer)
        found = more if found is None else found.unionByName(more)
        drawn, batch = drawn + batch, batch * 4
        have = found.limit(n).count()
    kept = found if have < n else threshold_select(found, one_row(found, n), F.col("id").cast("double"), ["id"])
    return kept.select("x", "y", *features, "target")


def with_absences(df: DataFrame, features: Sequence[str], **options) -> DataFrame:
    """The table itself if it has negatives, else with as many random ones as it has positives."""
    counts = df.agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg")).first()
    if counts["neg"]:
        return df
    made = random_absences(df.where("target = 1"), features, counts["pos"], **options)
    return df.select("x", "y", *features, "target").unionByName(made)


def bag_draws(df: DataFrame, key: str, bags: int, seed: int, ratio: float = 1.0) -> DataFrame:
    """bag and key: for each bag, of the unlabeled (target 0) rows as many as ``ratio`` times the positives, without replacement.

    All bags are drawn in one job; ranks are only taken in the bucket where a bag's count is reached.
    """
    spark = df.sparkSession
    free = df.where("target = 0").select(key)
    wanted = df.agg(F.least(F.greatest(F.bround(F.count_if(F.col("target") == 1) * F.lit(float(ratio)), 0).cast("long"), F.lit(1)), F.count_if(F.col("target") == 0)).alias("k"))
    numbers = spark.range(bags).select(F.col("id").cast("int").alias("bag"))
    spread = free.crossJoin(F.broadcast(numbers))
    return threshold_select(spread, numbers.crossJoin(wanted), portable_hash(key, F.col("bag") + (seed + 1)), [key], ["bag"]).select("bag", key)


def stratified_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Rows with ``fold``: each class is dealt in the order of the hash, so folds differ by one row of it at most."""
    rows = numbered(df, portable_hash(key, seed), [key], ["target"], "_number")
    return rows.withColumn("fold", F.pmod("_number", F.lit(k)).cast("int")).drop("_number")


def block_folds(df: DataFrame, size: float, k: int) -> DataFrame:
    """Rows with ``fold``: squares of the given size are dealt as wholes."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.floor(F.col("x") / size), F.floor(F.col("y") / size)), F.lit(k)).cast("int"))
