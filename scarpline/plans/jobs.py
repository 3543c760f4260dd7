"""The jobs that users call, composed of operators."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.functions.scalars import portable_hash
from scarpline.operators import cv, metrics, models, pu, selection
from scarpline.operators.fr import fr_table, index_map, long_classes
from scarpline.operators.pixels import grid_rows, pixel_key, sample_stack, valid_pixels
from scarpline.operators.sampling import block_folds, with_absences
from scarpline.operators.select import one_row, threshold_select
from scarpline.operators.spatial import away_from, buffer_control
from scarpline.operators.zones import success_auc, zone_capture, zone_distribution, zoned
from scarpline.sources.tables import Study, complete, dataset_summary, ordered, require_complete, saved, validated
from scarpline.sources.tiles import Tiles


def training_table(points: DataFrame, pixels: DataFrame | Tiles, meta: DataFrame, registry: DataFrame, fr: DataFrame, study: Study, pool_layer: str) -> DataFrame:
    """Presences (all of which must lie on every layer) and as many pseudo-absences away from them, with their features."""
    present = require_complete(saved(sample_stack(points, "point_id", pixels, meta, registry, fr, study.features)), study.features, "point_id")
    pool = away_from(valid_pixels(pixels, meta, pool_layer, study.pool_stride), points, study.buffer)
    keyed = pool.select(pixel_key().alias("point_id"), "row", "col", "x", "y")
    able = saved(complete(sample_stack(keyed, "point_id", pixels, meta, registry, fr, study.features), study.features))
    wanted, have = present.count(), able.count()
    if have < wanted:
        raise ValueError(f"{wanted} pseudo-absences are wanted, {have} places are there")
    # Row and column make one small number again, as the hash takes 31 bits of its key.
    number = F.shiftright("point_id", 32) * 100_003 + F.col("point_id").bitwiseAND((1 << 32) - 1)
    absent = threshold_select(able, one_row(able, wanted), portable_hash(number, study.seed), ["point_id"])
    return ordered(present.withColumn("target", F.lit(1)).unionByName(absent.withColumn("target", F.lit(0))), study.features)


def prediction_grid(pixels: DataFrame | Tiles, meta: DataFrame, registry: DataFrame, fr: DataFrame, study: Study, pool_layer: str) -> DataFrame:
    """x, y and features of every valid lattice pixel of the pool layer that has them all; each layer has its own transform."""
    grid = grid_rows(pixels, registry, fr, study.features, meta, study.grid_stride, pool_layer)
    return ordered(complete(grid, study.features), study.features)


def fr_analysis(pixels: DataFrame, classes: dict[str, str], hit: str = "hit", q: int = 5) -> dict[str, DataFrame]:
    """Weights, the index map in zones, the capture by zone, and the success-rate AUC, from wide class pixels."""
    weights = saved(fr_table(long_classes(pixels, classes, [hit]), hit))
    zones = zoned(saved(index_map(pixels, weights, classes)), "lsi", q)
    capture = zone_capture(zones, hit)
    return {"fr": weights, "zones": zones, "capture": capture, "auc": success_auc(capture)}


def scored_grid(grid: DataFrame, model: PipelineModel, q: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """x, y, lsi_prob, zone_id, zone_label. Scores are kept between the quantiles and the zoning; edges: those of an earlier batch."""
    scored = models.scores(model, grid, "lsi_prob").select("x", "y", "lsi_prob")
    scored = scored if edges is not None else saved(scored)
    return zoned(scored, "lsi_prob", q, edges=edges)


def susceptibility(df: DataFrame, key: str, study: Study, *, names: Sequence[str] = ("rf", "lr", "gbt"), method: str = "none", refine: bool = False, block: float | None = None, leave_one_out: bool = False, grid: DataFrame | None = None, run_id: str = "run", options: dict[str, dict] | None = None) -> dict:
    """Check, balance, refine, choose features, cross-validate, fit, report, and score a grid.

    A table without negatives gets random ones, and a new key. block: the side of squares that folds with a buffer are dealt
    by; None leaves these folds out. leave_one_out: logistic regression has each row as such a fold instead, however many rows there are.
    grid: x, y and features; its scores by the first model are cut into zones.

    Returns models by name, ``metrics`` (a long table for ``write_runs``: the run's figures and how long it took, the chosen features,
    scores of folds and of the fit), ``roc`` (points of each model by scheme: buffered and kfold of held-out rows, train_fit of its
    training rows), ``features``, ``importance`` (of each model), ``rows``; ``zones`` and ``distribution`` of the grid.
    """
    options, began = options or {}, time.monotonic()
    rows = validated(df, study.features)
    if key not in rows.columns:
        raise ValueError(f"Missing columns: {key}")
    spark = rows.sparkSession
    if rows.where("target = 0").isEmpty():
        rows = saved(with_absences(rows, study.features, x=study.x, y=study.y, buffer=study.buffer, seed=study.seed))
        rows = rows.withColumn(key, F.xxhash64("x", "y", "target"))
    if refine:
        rows = saved(buffer_control(rows, study.buffer, study.outer))
        rows = pu.refine(rows, key, study.features, models.factory("rf", study.seed, **options.get("rf", {})), study.keep_fraction, bags=study.bags, seed=study.seed)
    rows = saved(rows)
    picked = selection.choose(rows, key, study.features, method, seed=study.seed, **options.get(method, {}))
    chosen = spark.createDataFrame([(c, float(c in picked.chosen)) for c in study.features], "metric string, value double")
    chosen = chosen.select(F.lit(run_id).alias("run_id"), F.lit(method).alias("model"), F.lit("selection").alias("scheme"), F.lit(None).cast("int").alias("fold"), "metric", "value")
    found = [chosen]
    fitted: dict[str, PipelineModel] = {}
    roc: list[DataFrame] = []
    weight: list[DataFrame] = []
    curve = lambda scored, name, scheme: roc.append(metrics.roc_points(scored, "p").select(F.lit(name).alias("model"), F.lit(scheme).alias("scheme"), "threshold", "tpr", "fpr"))
    blocked = cv.with_excluded(block_folds(rows, block, study.folds), key, study.fold_radius) if block is not None and set(names) - ({"lr"} if leave_one_out else set()) else None
    for name in names:
        make, balance = models.factory(name, study.seed, **options.get(name, {})), "positives" if name == "gbt" else "classes"
        held = cv.stratified_predictions(rows, key, picked.chosen, make, study.folds, study.seed, balance)
        folds = cv.fold_aucs(held, study.folds)
        found += [metrics.long_metrics(folds, run_id, name, "kfold", F.col("fold")), metrics.long_metrics(metrics.fold_summary(folds), run_id, name, "kfold")]
        curve(held, name, "kfold")
        if block is not None:
            if name == "lr" and leave_one_out:
                held = cv.buffered_logistic(rows.withColumn("fold", F.col(key)), key, picked.chosen, study.fold_radius, options.get("lr", {}).get("c", 1.0))
            else:
                held = cv.buffered_cv(blocked, key, picked.chosen, make, study.fold_radius, balance=balance)
            held = saved(held.select(key, "target", "p"))
            found.append(metrics.long_metrics(cv.pooled_auc(held), run_id, name, "buffered"))
            curve(held, name, "buffered")
        fitted[name] = models.fit(rows, picked.chosen, make, balance)
        seen = saved(models.scores(fitted[name], rows))
        found.append(metrics.long_metrics(metrics.class_metrics(seen, F.col("p") > 0.5).crossJoin(metrics.auc(seen, "p")), run_id, name, "train_fit"))
        curve(seen, name, "train_fit")
        weight.append(models.importances(fitted[name], picked.chosen).withColumn("model", F.lit(name)))
    figures = {"features": len(study.features), "chosen": len(picked.chosen), "folds": study.folds, "seed": study.seed, "refined": int(refine), "bags": study.bags, "buffer": study.buffer, "outer": study.outer, "fold_radius": study.fold_radius, "block": block, "leave_one_out": int(leave_one_out), "elapsed": time.monotonic() - began}
    summary = dataset_summary(rows).select("n", "n_pos", "n_neg").withColumns({n: F.lit(v).cast("double") for n, v in figures.items()})
    found.insert(0, metrics.long_metrics(summary, run_id, "", "run"))
    out = {"models": fitted, "metrics": reduce(DataFrame.unionByName, found), "roc": reduce(DataFrame.unionByName, roc), "features": picked, "importance": reduce(DataFrame.unionByName, weight), "rows": rows}
    if grid is not None:
        out["zones"] = scored_grid(grid, fitted[names[0]], study.zones)
        out["distribution"] = zone_distribution(out["zones"], "lsi_prob")
    return out
