"""Boundary cases, small enough to be computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from scarpline.functions.scalars import as_class, missing, reclass_breaks, utm
from scarpline.operators import cv, fr, metrics, models, pixels, pu, sampling, scaling, selection, spatial, zones
from scarpline.operators.select import bottom_fraction, exact_quantiles, kept_count, one_row, threshold_select
from scarpline.plans import jobs
from scarpline.sources import tables
from scarpline.streaming import scoring


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def points(spark, rows, more=""):
    return spark.createDataFrame(rows, "id long, x double, y double" + more)


def test_buffers_keep_what_is_on_the_edge(spark):
    one = points(spark, [(1, 0.0, 0.0)])
    many = points(spark, [(1, 500.0, 0.0), (2, 499.0, 0.0), (3, 300.0, 400.0), (4, 2000.0, 0.0), (5, -2000.5, 0.0)])
    assert values(spatial.away_from(many, one, 500.0), "id") == [(1,), (3,), (4,), (5,)]
    assert values(spatial.ring(many, one, 500.0, 2000.0), "id") == [(1,), (3,), (4,)]


@pytest.mark.parametrize("leaf", [1, 16])
def test_min_distance(spark, leaf):
    reference = points(spark, [(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, None, 7.0)])
    found = spatial.min_distance(points(spark, [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 9000.0, 0.0), (4, None, 3.0), (5, 1.0, None)]), reference, "id", leaf=leaf)
    assert [(r.id, r.distance) for r in found.orderBy("id").collect()] == [(1, 0.0), (2, 5.0), (3, 4000.0), (4, None), (5, None)]
    assert values(spatial.min_distance(reference.dropna(), reference.limit(0), "id"), "distance") == [(math.inf,), (math.inf,)]


def test_distance_join_is_the_plain_join(spark):
    rows = points(spark, [(i, float(i * 7919 % 1000), float(i * 104729 % 1000)) for i in range(300)])
    got = values(spatial.distance_join(rows, rows, 60.0), "id", "right_id")
    data = [(r.id, r.x, r.y) for r in rows.collect()]
    assert got == sorted((a, b) for a, x, y in data for b, u, v in data if (x - u) ** 2 + (y - v) ** 2 <= 3600)


def test_buffer_control(spark):
    rows = points(spark, [(1, 0.0, 0.0, 1), (2, 10.0, 0.0, 0)], ", target int")
    with pytest.raises(ValueError, match="No negatives"):
        spatial.buffer_control(rows, 500.0)
    alone = rows.where("target = 1")
    assert values(spatial.buffer_control(alone, 500.0)) == values(alone)


def test_fold_census_excludes_the_edge(spark):
    rows = points(spark, [(1, 0.0, 0.0, 1), (2, 1000.0, 0.0, 0), (3, 5000.0, 0.0, 0)], ", target int")
    assert values(spatial.fold_census(rows, "id", 1000.0)) == [(1, 2, 1, 0, False), (2, 2, 1, 0, False), (3, 1, 2, 1, True)]


def test_zones_of_doubled_edges_and_of_one_score(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.0, 0.0, 0.0, 0.1, 0.2, 0.2, 0.3, 0.9, 0.9)], "v double")
    assert [z for _, z in values(zones.zoned(rows, "v"), "v", "zone_id")] == [0, 0, 0, 0, 1, 1, 1, 2, 3, 3]
    same = spark.createDataFrame([(1.0,)] * 4, "v double")
    assert set(values(zones.zoned(same, "v"), "zone_id", "zone_label")) == {(0, "Very Low")}
    distribution = values(zones.zone_distribution(zones.zoned(same, "v"), "v"), "zone_id", "n", "percent")
    assert distribution == [(0, 4, 100.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0)]


def test_classes(spark):
    row = spark.range(1).select(as_class(F.lit(2.5)), as_class(F.lit(3.5)), missing(F.lit(-9999.0005), F.lit(-9999.0)), missing(F.lit(float("nan"))), reclass_breaks(F.lit(300.0), [300.0, 600.0])).first()
    assert tuple(row) == (2, 4, None, None, 2)


def test_fr_formula_and_unknown_class(spark):
    rows = spark.createDataFrame([("f", 1, 1)] * 2 + [("f", 1, 0)] * 6 + [("f", 2, 1)] * 1 + [("f", 2, 0)] * 1, "factor string, class int, hit int")
    table = fr.fr_table(rows)
    assert values(table, "class", "S_i", "N_i_all", "FR") == [(1, 8, 2, pytest.approx(2 / 3 / 0.8)), (2, 2, 1, pytest.approx(1 / 3 / 0.2))]
    found = fr.fr_lookup(spark.createDataFrame([("f", 1.0), ("f", 9.0)], "factor string, value double"), table)
    assert [r["FR"] is None for r in found.orderBy("value").collect()] == [False, True]


def test_metrics_at_their_limits(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "p double, target int")
    assert metrics.auc(rows, "p").first()["auc"] == 0.875
    assert metrics.auc(rows.where("target = 1"), "p").first()["auc"] is None
    assert values(metrics.class_metrics(rows, F.lit(False))) == [(0.5, 0.0, 0.0, 0.0)]
    assert values(metrics.roc_points(rows, "p"), "threshold", "tpr", "fpr") == [(0.1, 1.0, 1.0), (0.4, 1.0, 0.5), (0.9, 0.5, 0.0)]


def test_selection_of_the_lowest(spark):
    rows = spark.createDataFrame([(i, float(i * 37 % 11)) for i in range(200)], "id long, v double")
    expected = sorted((r.v, r.id) for r in rows.collect())
    for k in (0, 1, 19, 200, 500):
        assert values(threshold_select(rows, one_row(rows, k), F.col("v"), ["id"]), "v", "id") == expected[:k]
    assert values(bottom_fraction(rows, "v", "id", 0.25), "v", "id") == expected[:50]
    assert [spark.range(1).select(kept_count(F.lit(n), 0.5)).first()[0] for n in (5, 7, 0)] == [2, 4, 1]


def test_quantiles_are_exact(spark):
    import numpy as np

    for data in ([float(i * 37 % 101) ** 3 for i in range(3000)], [1.0] * 900 + [1e12], [2.5], [0.1 * i for i in range(7)]):
        rows = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double").repartition(3)
        found = exact_quantiles(rows, "v", [0.0, 0.2, 0.5, 0.77, 1.0]).first()["quantiles"]
        assert found == pytest.approx(np.quantile(data, [0.0, 0.2, 0.5, 0.77, 1.0]).tolist(), rel=1e-12)
    assert exact_quantiles(rows.where("v > 100"), "v", [0.5]).first()["quantiles"] is None


def test_selection_with_outliers_and_wide_keys(spark):
    rows = spark.createDataFrame([(i * 6_148_914_691_236_517 - (1 << 62), 1e15 if i == 7 else float(i % 3), i % 2) for i in range(500)], "id long, v double, target int")
    expected = sorted((r.v, r.id) for r in rows.collect())
    assert values(threshold_select(rows, one_row(rows, 200), F.col("v"), ["id"]), "v", "id") == expected[:200]
    assert sampling.stratified_folds(rows, "id", 5, 1).count() == 500 and sampling.bag_draws(rows, "id", 2, 1).count() == 500
    assert sampling.first_by_hash(rows, "id", 9, 3).count() == 9


def test_pixels_without_nodata_and_with_two_sizes(spark):
    pixel = spark.createDataFrame([("a", r, c, float(1 + (r + c) % 2)) for r in range(4) for c in range(4)] + [("b", r, c, 5.0 + r) for r in range(2) for c in range(2)], "layer string, row int, col int, value double")
    meta = spark.createDataFrame([("a", 0.0, 40.0, 10.0, 10.0, 2.0), ("b", 0.0, 40.0, 20.0, 20.0, None)], "layer string, x0 double, y0 double, px double, py double, nodata double")
    registry = spark.createDataFrame([("a_fr", "fa", "a"), ("b_fr", "fb", "b")], "column string, factor string, layer string")
    weights = spark.createDataFrame([("fa", 1, 0.5), ("fa", 2, 0.7), ("fb", 5, 1.5), ("fb", 6, 2.5)], "factor string, class int, FR double")
    assert pixels.valid_pixels(pixel, meta, "b", 1).count() == 4 and pixels.valid_pixels(pixel, meta, "a", 1).count() == 8
    at = points(spark, [(1, 5.0, 35.0), (2, 15.0, 35.0), (3, 39.0, 1.0), (4, 99.0, 1.0)])
    got = {(r.id, r.layer): r.value for r in pixels.sample_layers(at, "id", pixel, meta).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): None, (3, "a"): 1.0, (4, "a"): None, (1, "b"): 5.0, (2, "b"): 5.0, (3, "b"): 6.0, (4, "b"): None}
    grid = jobs.prediction_grid(pixel, meta, registry, weights, tables.Study(features=("a_fr", "b_fr"), grid_stride=1), "a")
    assert values(grid) == sorted((10.0 * c + 5, 40 - 10.0 * r - 5, 0.5, 1.5 + r // 2) for r in range(4) for c in range(4) if (r + c) % 2 == 0)


def test_scans_and_sinks(spark, tmp_path):
    rows = points(spark, [(1, 1.0, 2.0, 0.5, 1), (2, 3.0, 4.0, 0.25, 0)], ", f double, target int").drop("id")
    for end in ("", ".csv"):
        tables.write(rows, f"{tmp_path}/rows{end}")
        assert values(tables.scan(spark, f"{tmp_path}/rows{end}", tables.training_schema(["f"])), "x", "y", "f", "target") == values(rows, "x", "y", "f", "target")
    with pytest.raises(ValueError, match="Missing columns: g"):
        tables.scan(spark, f"{tmp_path}/rows.csv", tables.training_schema(["g"]))
    one = spark.createDataFrame([("f", 1, 0.5), ("f", 1, 0.7)], "factor string, class int, FR double")
    for f, t in ((f.name, f.dataType) for f in tables.fr_schema()):
        one = one if f in one.columns else one.withColumn(f, F.lit(None).cast(t))
    tables.write(one, f"{tmp_path}/fr")
    with pytest.raises(ValueError, match="Classes given twice"):
        tables.scan_fr(spark, f"{tmp_path}/fr")
    tables.write(one.where("FR < 0.6"), f"{tmp_path}/fr1")
    assert tables.scan_fr(spark, f"{tmp_path}/fr1").count() == 1
    tables.write(rows.select(F.lit(1).alias("point_id"), "x", "y"), f"{tmp_path}/points")
    with pytest.raises(ValueError, match="reference system"):
        tables.scan_points(spark, f"{tmp_path}/points")
    tables.write(rows.select(F.lit(1).alias("point_id"), "x", "y", F.lit("EPSG:32646").alias("crs")), f"{tmp_path}/points1")
    assert tables.scan_points(spark, f"{tmp_path}/points1").count() == 2


def test_absences_are_made_only_where_there_are_none(spark):
    rows = points(spark, [(i, 100.0 * i, 0.0, 0.5, 1) for i in range(5)], ", f double, target int")
    box = {"x": (0.0, 1000.0), "y": (0.0, 1000.0), "buffer": 50.0}
    made = sampling.with_absences(rows, ["f"], **box)
    assert values(made.groupBy("target").count()) == [(0, 5), (1, 5)] and values(made) == values(sampling.with_absences(rows.repartition(5), ["f"], **box))
    both = rows.unionByName(rows.withColumn("target", F.lit(0)).limit(1))
    assert sampling.with_absences(both, ["f"], **box) is both


def test_whole_jobs(spark, tmp_path):
    pixel = spark.createDataFrame([(1 + i % 3, 1 + i % 2, int(i % 3 == 0)) for i in range(60)], "a int, b int, hit int")
    found = jobs.fr_analysis(pixel, {"fa": "a", "fb": "b"}, q=2)
    assert found["fr"].count() == 5 and found["zones"].count() == 60 and found["capture"].agg(F.sum("hits")).first()[0] == 20 and 0.5 <= found["auc"].first()["auc"] <= 1
    rows = points(spark, [(i, 1000.0 + i * 37 % 900, 1000.0 + i * 91 % 900, 1.0 + i % 5 / 10, 1) for i in range(40)], ", a double, target int").withColumn("b", F.col("id") % 3 / 3.0)
    study = tables.Study(features=("a", "b"), x=(0.0, 3000.0), y=(0.0, 3000.0), buffer=50.0, folds=2, bags=2, keep_fraction=0.5, fold_radius=20.0)
    grid = rows.select("x", "y", "a", "b")
    job = jobs.susceptibility(rows, "id", study, names=("lr",), method="cart", refine=True, block=800.0, grid=grid, options={"lr": {"rounds": 10}, "rf": {"trees": 3, "depth": 3}})
    assert values(job["rows"].groupBy("target").count()) == [(0, 20), (1, 40)]
    assert {r.scheme for r in job["metrics"].collect()} == {"run", "selection", "kfold", "buffered", "train_fit"}
    assert {(r.model, r.scheme) for r in job["roc"].collect()} == {("lr", s) for s in ("kfold", "buffered", "train_fit")}
    figures = {r.metric: r.value for r in job["metrics"].where("scheme = 'run'").collect()}
    assert figures["refined"] == 1 and figures["buffer"] == 50 and figures["fold_radius"] == 20 and figures["elapsed"] > 0
    assert values(job["importance"], "model", "feature") == [("lr", "a"), ("lr", "b")]
    assert job["zones"].count() == 40 and job["distribution"].agg(F.sum("n")).first()[0] == 40
    assert selection.choose(rows, "id", ["a", "b"]).chosen == ["a", "b"]
    with pytest.raises(ValueError, match="method"):
        selection.choose(rows, "id", ["a"], "x")
    # The same on a stream, with the edges of the batch.
    tables.write(grid, f"{tmp_path}/grid")
    edges = zones.quantile_edges(job["zones"], "lsi_prob", study.zones)
    stream = scoring.stream_zones(spark.readStream.schema(grid.schema).parquet(f"{tmp_path}/grid"), job["models"]["lr"], edges)
    query = stream.writeStream.format("memory").queryName("zones_of_stream").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert values(spark.table("zones_of_stream").groupBy("zone_id").count()) == values(job["zones"].groupBy("zone_id").count())
    tables.write(spark.createDataFrame([("fa", 1.0), ("fa", 9.0)], "factor string, value double"), f"{tmp_path}/px")
    weighted = scoring.stream_weights(spark.readStream.schema("factor string, value double").parquet(f"{tmp_path}/px"), found["fr"])
    query = weighted.writeStream.format("memory").queryName("weights_of_stream").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.FR is None for r in spark.table("weights_of_stream").collect()) == [False, True]


def test_refinement_without_unlabeled_rows(spark):
    rows = points(spark, [(1, 0.0, 0.0, 1.0, 1)], ", a double, target int")
    assert pu.refine(rows, "id", ["a"], models.factory("rf")) is rows


def test_folds_and_bags(spark):
    rows = points(spark, [(i, 0.0, 0.0, int(i % 3 == 0)) for i in range(100)], ", target int")
    folds = sampling.stratified_folds(rows, "id", 5, 1)
    sizes = [n for *_, n in values(folds.groupBy("target", "fold").count())]
    assert max(sizes[:5]) - min(sizes[:5]) <= 1 and max(sizes[5:]) - min(sizes[5:]) <= 1 and sum(sizes) == 100
    drawn = sampling.bag_draws(rows, "id", 3, 1)
    assert values(drawn.groupBy("bag").count()) == [(0, 34), (1, 34), (2, 34)] and drawn.distinct().count() == 102
    assert values(drawn) == values(sampling.bag_draws(rows.repartition(7), "id", 3, 1))


def test_random_absences_and_shortage(spark):
    near = points(spark, [(1, 50.0, 50.0)])
    made = sampling.random_absences(near, ["f"], 20, (0.0, 1000.0), (0.0, 1000.0), 100.0)
    assert made.count() == 20 and all((r.x - 50) ** 2 + (r.y - 50) ** 2 >= 10_000 and 0 <= r.f <= 1.5 and r.target == 0 for r in made.collect())
    assert sampling.random_absences(near, ["f"], 5, (0.0, 100.0), (0.0, 100.0), 500.0, tries=10).count() == 0
    with pytest.raises(ValueError):
        sampling.first_by_hash(near, "id", 2, 1)


def test_constant_features(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0.1), (2.0, 4.0, 0.1), (3.0, 6.1, 0.1)], "a double, b double, c double")
    kept, dropped = scaling.correlated(rows, ["a", "b", "c"])
    assert (kept, dropped) == (["a", "c"], ["b"])
    assert {r["feature"]: r["sd"] for r in scaling.scaler_stats(rows, ["c"]).collect()} == {"c": 0.0}
    assert all(abs(r["c"]) < 1e-12 for r in scaling.scaled(rows, ["a", "c"]).collect())


def test_checks(spark):
    good = points(spark, [(1, 0.0, 0.0, 1.0, 1)], ", f double, target int")
    assert tables.validated(good, ["f"]) is good
    with pytest.raises(ValueError, match="Missing columns: g"):
        tables.validated(good, ["f", "g"])
    with pytest.raises(ValueError, match="Null values"):
        tables.validated(good.withColumn("f", F.lit(float("nan"))), ["f"])
    with pytest.raises(ValueError, match="target column"):
        tables.validated(good.withColumn("target", F.lit(2)), ["f"])


def test_utm(spark):
    # The meridian's scale and a published point: 93 E on the equator is 500 km; the CN Tower is in zone 17.
    x, y = utm(F.lit(93.0), F.lit(0.0), 46)
    u, v = utm(F.lit(-79.387139), F.lit(43.642567), 17)
    row = spark.range(1).select(x, y, u, v).first()
    assert tuple(row) == (pytest.approx(500_000, abs=1e-6), pytest.approx(0, abs=1e-6), pytest.approx(630_084, abs=1), pytest.approx(4_833_438, abs=1))


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, float(i % 40) * 100, float(i // 40) * 100, float(i % 2) * 2 + (i * 37 % 10) / 10, float(i * 13 % 7), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "id long, x double, y double, a double, b double, target int").cache()


def test_models(spark, separable, tmp_path):
    for name, options in (("rf", {"trees": 5, "depth": 3}), ("lr", {}), ("gbt", {"rounds": 3})):
        model = models.train(separable, ["a", "b"], name, **options)
        found = models.scores(model, separable)
        assert metrics.auc(found, "p").first()["auc"] > 0.95
        assert found.where("p < 0 or p > 1").isEmpty()
    models.save(model, f"file://{tmp_path}/m")
    assert values(models.scores(models.load(f"file://{tmp_path}/m"), separable), "id", "p") == values(found, "id", "p")
    assert selection.ranked(separable, ["a", "b"])[0][0] == "a"


def test_buffered_folds_keep_their_distance(spark, separable):
    rows = sampling.block_folds(separable, 1000.0, 3)
    out = cv.excluded_folds(rows, "id", 250.0)
    data = {r.id: r for r in rows.collect()}
    for r in out.collect():
        a = data[r.id]
        assert set(r.excluded) == {b.fold for b in data.values() if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 250.0**2}
    census = {r.fold: r.n_train for r in cv.fold_membership(rows, "id", 250.0).collect()}
    assert census == {f: sum(f not in r.excluded for r in out.collect()) for f in census}
    assert cv.pooled_auc(cv.buffered_cv(rows, "id", ["a", "b"], models.factory("lr"), 150.0)).first()["auc"] > 0.9
    with pytest.raises(ValueError, match="folds"):
        cv.buffered_cv(rows.withColumn("fold", F.col("id")), "id", ["a"], models.factory("lr"), 150.0, max_folds=10)


def test_refinement_keeps_positives(spark, separable):
    kept = pu.refine(separable, "id", ["a", "b"], models.factory("rf", trees=3, depth=3), 0.5, bags=2)
    assert values(kept.groupBy("target").count()) == [(0, 30), (1, 60)]
    with pytest.raises(ValueError):
        pu.bagged(separable.where("target = 1"), "id", ["a"], models.factory("lr"))
