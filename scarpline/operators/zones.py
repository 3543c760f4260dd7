"""Zones by quantiles of a score, and how well they capture presences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators.select import exact_quantiles, sketch, sketched_quantiles
from scarpline.sources.tables import ZONES


def quantile_edges(df: DataFrame, score: str, q: int = 5) -> DataFrame:
    """One row, ``edges``: the distinct quantiles at 0, 1/q .. 1, exact; no task gets all scores."""
    return exact_quantiles(df, score, [i / q for i in range(q + 1)]).select(F.array_distinct(F.coalesce("quantiles", F.array().cast("array<double>"))).alias("edges"))


def score_sketches(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """by and ``sketch``: a mergeable sketch of the scores of each batch, to be kept with it; some 100 kB each."""
    return df.groupBy(*by).agg(sketch(F.col(score)).alias("sketch"))


def sketched_edges(sketches: DataFrame, q: int = 5) -> DataFrame:
    """One row, ``edges``, from the sketches of any number of batches: near the quantiles of all their scores, which are not read again."""
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    found = sketched_quantiles(F.col("sketch"), [i / q for i in range(q + 1)])
    return merged.select(F.array_distinct(F.coalesce(found, F.array().cast("array<double>"))).alias("edges"))


def zone_of(score: Column, edges: Column) -> Column:
    """The zone from 0: bins are closed on the right, the lowest value is in the first; equal scores make one zone."""
    return F.when(score.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < score)) - 1, F.lit(0)))


def zone_label(zone: Column, labels: Sequence[str] = ZONES) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in labels)), zone + 1)


def zoned(df: DataFrame, score: str, q: int = 5, labels: Sequence[str] = ZONES, edges: DataFrame | None = None) -> DataFrame:
    """Rows with zone_id and zone_label. edges: a one-row table from an earlier batch, for streams."""
    edges = quantile_edges(df, score, q) if edges is None else edges
    marked = df.crossJoin(F.broadcast(edges)).withColumn("zone_id", zone_of(F.col(score), F.col("edges")))
    return marked.withColumn("zone_label", zone_label(F.col("zone_id"), labels)).drop("edges")


def zone_distribution(df: DataFrame, score: str, labels: Sequence[str] = ZONES) -> DataFrame:
    """zone_id, zone_label, n, percent, least, most for each label; zones without rows count 0."""
    counts = df.groupBy("zone_id").agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most"))
    total = df.agg(F.count("*").alias("_total"))
    named = df.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("zone_id")).withColumn("zone_label", zone_label(F.col("zone_id"), labels))
    joined = named.join(F.broadcast(counts), "zone_id", "left").crossJoin(F.broadcast(total))
    percent = F.coalesce(F.try_divide(100 * F.col("n"), F.col("_total")), F.lit(0.0))
    return joined.select("zone_id", "zone_label", F.coalesce("n", F.lit(0)).alias("n"), percent.alias("percent"), "least", "most")


def zone_capture(df: DataFrame, hit: str = "hit") -> DataFrame:
    """zone_id, area, hits, their shares, and both shares summed up from the highest zone (some rows, so one window is enough)."""
    counts = df.groupBy("zone_id").agg(F.count("*").alias("area"), F.sum(hit).cast("long").alias("hits"))
    whole, down = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("zone_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = counts.withColumns({"area_share": F.col("area") / F.sum("area").over(whole), "hit_share": F.coalesce(F.try_divide(F.col("hits"), F.sum("hits").over(whole)), F.lit(0.0))})
    return shares.withColumns({"area_upto": F.sum("area_share").over(down), "hit_upto": F.sum("hit_share").over(down)})


def success_auc(capture: DataFrame) -> DataFrame:
    """One row, ``auc``: the area under summed hit share against summed area share, from (0, 0), by trapezoids."""
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("zone_id"))
    before = lambda c: F.coalesce(F.lag(c).over(down), F.lit(0.0))
    strip = (F.col("area_upto") - before("area_upto")) * (F.col("hit_upto") + before("hit_upto")) / 2
    return capture.withColumn("_strip", strip).agg(F.sum("_strip").alias("auc"))
