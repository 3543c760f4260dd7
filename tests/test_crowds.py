"""Crowded places: buffers that leave nothing, copies of places, folds that are single rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import cv, expansion, models, newton, sampling, spatial
from scarpline.plans import jobs, queries


def points(spark, rows, more=""):
    return spark.createDataFrame(rows, "id long, x double, y double" + more)


def test_fewer_absences_than_wanted(spark):
    near = points(spark, [(i, 0.0, 0.0) for i in range(5)])
    free = points(spark, [(1, 0.0, 499.0), (2, 500.0, 0.0), (3, 900.0, 0.0)])
    drawn = lambda rows: sorted(r.id for r in sampling.pseudo_absences(rows, near, "id", 10, 500.0, 42, exact=False).collect())
    assert drawn(free) == [2, 3] and drawn(free.where("id = 1")) == []


def test_buffer_that_leaves_no_negative(spark):
    rows = points(spark, [(1, 0.0, 0.0, 1), (2, 10.0, 0.0, 0)], ", target int")
    assert [r.id for r in spatial.buffer_control(rows, 500.0, 900.0, some=False).collect()] == [1]


def test_rows_left_out_are_fitted_from_sums(spark, monkeypatch):
    """Places that rows share and rows without a place, against the fits of all folds over the rows; no fold is fitted over the rows."""
    dice = np.random.default_rng(5)
    at, x = dice.integers(0, 100, size=(4000, 2)) * 100.0, dice.normal(size=(4000, 2)) * [1, 40] + [5, 900]
    y = (x[:, 0] - 5 + (x[:, 1] - 900) / 40 + dice.normal(size=4000) > 0).astype(int)
    data = [(i, *map(float, at[i]), *map(float, x[i]), 1.5, int(y[i])) for i in range(4000)] + [(4000, None, 1.0, 5.0, 900.0, 1.5, 1), (4001, float("nan"), 1.0, 4.0, 950.0, 1.5, 0)]
    rows = points(spark, data, ", a double, b double, c double, target int").withColumn("fold", F.col("id")).repartition(3)
    found, fitted = newton.fit_folds(rows, ["a", "b", "c"], cv.excluded_folds(rows, "id", 100.0), "id")
    want = {r.id: r.p for r in newton.fold_predictions(found, fitted, "id").collect()}
    monkeypatch.setattr(cv, "fit_folds", None)
    monkeypatch.setattr(expansion, "SITES", 5)  # groups of a crowded cell
    monkeypatch.setattr(expansion, "ROWS", 7)
    got = {r.id: r.p for r in cv.buffered_logistic(rows, "id", ["a", "b", "c"], 100.0).collect()}
    assert len(want) == 4002 and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-8


def test_folds_near_a_crowd(spark):
    """Labels given by whole cells, by boxes and by tests, on rows that share places; whole cells meet no points."""
    dice = np.random.default_rng(6)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(dice.integers(-30, 30, size=(400, 2)) * 20)] + [(400, None, 1.0), (401, 600.0, 0.0), (402, 900.0, 0.0)]
    rows = points(spark, data).withColumn("fold", F.when(F.col("id") < 395, (F.col("x") > 100).cast("int") + F.floor(F.col("y") / 500).cast("int")))
    near = [(r.x, r.y, r.fold) for r in rows.collect() if r.x is not None]
    for r in (20.0, 150.0, 300.0):
        want = {(x, y, f) for x, y, _ in near for u, v, f in near if f is not None and (x - u) ** 2 + (y - v) ** 2 <= r * r}
        got = [(g.x, g.y, g.fold) for g in spatial.near_labels(rows, "fold", r).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    crowd = points(spark, [(i, float(i % 50), 0.0) for i in range(5000)]).withColumn("fold", F.col("id") % 2)
    assert {r.fold: r.n_train for r in cv.fold_membership(crowd, "id", 100.0).collect()} == {0: 0, 1: 0}


def test_pairs_of_crowded_places(spark):
    """Two million pairs of rows are four of places."""
    crowd = spark.range(2000).selectExpr("id", "CAST(id % 2 AS DOUBLE) AS x", "0D AS y")
    near = points(spark, [(i, float(i % 2 * 30), 0.0) for i in range(1000)] + [(1000, 99.0, 0.0), (1001, None, 0.0)])
    found = spatial.near_summary(near, crowd, "id", 29.5)
    assert {(r.id % 2, r.n, r.first) for r in found.collect()} == {(0, 2000, 0), (1, 1000, 1)} and found.count() == 1000
    small = near.where("id < 4 or id > 999").unionByName(points(spark, [(5, 60.0, 1.0), (6, 60.0, 1.0)]))
    rows = [(r.id, r.x, r.y) for r in small.collect()]
    want = {a: [b for b, u, v in rows if None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 1600] for a, x, y in rows}
    assert {(r.id, r.n, r.first) for r in spatial.near_summary(small, small, "id", 40.0).collect()} == {(a, len(b), min(b)) for a, b in want.items() if b}


def test_rows_of_a_fit_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000 / 10).alias("a"), (F.col("id") % 2).cast("int").alias("target")).coalesce(1)
    parts = models.shared_out(rows).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 1000 and max(r["count"] for r in parts) <= 150
    assert models.shared_out(rows.limit(50)).rdd.getNumPartitions() == 1


def test_each_row_is_a_fold_however_many(spark, tmp_path, monkeypatch):
    """The job's buffered score of logistic regression is that of leave-one-out for more than 20,000 rows too."""
    key, drawn = F.col("id") % 40 + F.floor(F.col("id") / 40) * 150_000, lambda n, seed: F.pmod(F.hash("id", F.lit(seed)), F.lit(n))
    rows = spark.range(20_040).select(key.alias("c_custkey"), (drawn(1000, 1) / 10).alias("c_acctbal"), drawn(25, 2).alias("c_nationkey"), F.when(drawn(5, 3) == 0, "BUILDING").otherwise("OTHER").alias("c_mktsegment"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    whole = jobs.susceptibility
    monkeypatch.setattr(jobs, "susceptibility", lambda *given, **named: whole(*given, names=("lr",), **named))
    found = {(r.scheme, r.metric): r.value for r in queries.ml_pipeline(spark, str(tmp_path)).where("fold is null").collect()}
    want = cv.pooled_auc(queries.leave_one_out(spark, str(tmp_path))).first()["auc"]
    assert found["run", "n"] == 20_040 and found["run", "leave_one_out"] == 1 and found["buffered", "auc"] == pytest.approx(want, abs=1e-9)
