"""Frequency ratios: class weights from pixel counts, their lookup, and the summed index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.functions.scalars import as_class, index_sum


def long_classes(pixels: DataFrame, classes: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """factor, class and the kept columns: one row for each pixel and factor; classes: factor to class column."""
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(c).cast("int").alias("class")) for f, c in classes.items())))
    return pixels.select(*keep, stacked.alias("_c")).select("_c.factor", "_c.class", *keep)


def fr_table(classes: DataFrame, hit: str = "hit", train: str | None = None, area_total: float | None = None) -> DataFrame:
    """factor, class, S_i, N_i_train, N_i_all, area_pct, FR, FRn, FR_gt_1 from rows of factor, class and hit (0 or 1).

    train: a 0/1 column that says which hits count for FR; all do without it. area_total: pixels of the whole area, by default
    those of each factor. One shuffle of partial counts; the rest works on one row for each class.
    """
    trained = F.col(hit) * F.col(train) if train else F.col(hit)
    counts = classes.where(F.col("class").isNotNull()).groupBy("factor", "class").agg(F.count("*").alias("S_i"), F.sum(trained).cast("long").alias("N_i_train"), F.sum(hit).cast("long").alias("N_i_all"))
    whole = Window.partitionBy("factor")
    area = F.sum("S_i").over(whole) if area_total is None else F.lit(float(area_total))
    share = F.col("S_i") / area
    ratio = F.try_divide(F.try_divide(F.col("N_i_train"), F.sum("N_i_train").over(whole)), share)
    weighted = counts.withColumns({"area_pct": 100 * share, "FR": ratio})
    top = F.max("FR").over(whole)
    return weighted.withColumns({"FRn": F.try_divide(F.col("FR"), top), "FR_gt_1": F.col("FR") > 1})


def source_stats(df: DataFrame, class_: Column, source: str) -> DataFrame:
    """class, src_min, src_max, src_mean of the continuous layer behind the classes."""
    return df.groupBy(class_.alias("class")).agg(F.min(source).alias("src_min"), F.max(source).alias("src_max"), F.avg(source).alias("src_mean"))


def fr_lookup(pixels: DataFrame, fr: DataFrame, value: str = "value") -> DataFrame:
    """Pixels (with factor and a class value) with their FR; unknown classes and missing values get null.

    fr has a row for each factor and class, some dozens in all, so it is broadcast.
    """
    weights = fr.select("factor", F.col("class").alias("_class"), F.col("FR"))
    return pixels.withColumn("_class", as_class(value)).join(F.broadcast(weights), ["factor", "_class"], "left").drop("_class")


def index_map(pixels: DataFrame, fr: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Wide pixels with <factor>_fr for each factor and their sum, lsi."""
    out = pixels
    for factor, column in classes.items():
        weights = fr.where(F.col("factor") == factor).select(F.col("class").alias(column), F.col("FR").alias(f"{factor}_fr"))
        out = out.join(F.broadcast(weights), column, "left")
    return out.withColumn("lsi", index_sum([f"{f}_fr" for f in classes]))
