"""Zoning and class weights on streams: the same row-wise functions, with tables fixed by an earlier batch."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.fr import fr_lookup
from scarpline.operators.zones import score_sketches
from scarpline.plans.jobs import scored_grid


def stream_weights(pixels: DataFrame, fr: DataFrame) -> DataFrame:
    """Class weights for a stream of pixels (factor, value)."""
    return fr_lookup(pixels, fr)


def stream_zones(grid: DataFrame, model: PipelineModel, edges: DataFrame) -> DataFrame:
    """Scores and zones for a stream of grid rows; edges: a one-row table of an earlier batch, as a stream has no last quantile."""
    return scored_grid(grid, model, edges=edges)


def keep_sketches(scored: DataFrame, score: str, path: str):
    """A writer for a stream of scores: each micro-batch adds one sketch to a table at ``path``; ``zones.sketched_edges`` of it gives the edges so far.

    A batch that runs again replaces its own sketch.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = score_sketches(batch, score).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return scored.writeStream.foreachBatch(add)
