"""Draws, selections, distances and folds against plain Python, on rows that repeat, lack values, tie and crowd."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.functions.scalars import degrees, portable_hash, utm
from scarpline.operators import cv, metrics, models, newton, pixels, pu, sampling, select, selection, spatial, zones
from scarpline.operators.select import exact_quantiles, one_row, ranked_values, threshold_select
from scarpline.sources import tables
from scarpline.sources.tiles import Tiles, morton, write_tiles
from scarpline.streaming import scoring


def points(spark, rows, more=""):
    return spark.createDataFrame(rows, "id long, x double, y double" + more)


# --- draws ---


def test_hashes_of_seeds_are_independent(spark):
    rows = spark.range(20_000).select(*(portable_hash("id", s).alias(f"h{s}") for s in (1, 2, 43)), portable_hash(F.col("id") - (1 << 62), 1).alias("wide"))
    low = rows.select(*(F.col(c) < (1 << 31) * 0.1 for c in rows.columns)).toDF(*rows.columns)
    n, k = 20_000, 2000
    for c in rows.columns:
        assert abs(low.where(c).count() - k) < 4 * math.sqrt(k * 0.9)
    for a, b in (("h1", "h2"), ("h1", "h43"), ("h1", "wide")):
        assert abs(low.where(F.col(a) & F.col(b)).count() - k * k / n) < 4 * math.sqrt(k * k / n)
    assert rows.select("h1").distinct().count() == n  # a permutation of small numbers
    assert abs(rows.agg(F.corr("h1", "h2")).first()[0]) < 4 / math.sqrt(n)


def test_bags_and_folds_of_seeds_differ(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 5 == 0).cast("int").alias("target"))
    bags = {b: {r.id for r in group} for b in range(4) for group in [sampling.bag_draws(rows, "id", 4, 42).where(F.col("bag") == b).collect()]}
    again = {(r.bag, r.id) for r in sampling.bag_draws(rows.repartition(7), "id", 4, 42).collect()}
    assert again == {(b, i) for b, ids in bags.items() for i in ids} and all(len(ids) == 800 for ids in bags.values())
    for a in range(4):
        for b in range(a):
            assert abs(len(bags[a] & bags[b]) - 800 * 800 / 3200) < 4 * math.sqrt(200 * 0.75 * 0.75)
    one, other = ({r.id: r.fold for r in sampling.stratified_folds(rows, "id", 5, s).collect()} for s in (42, 43))
    assert abs(sum(one[i] == other[i] for i in one) - 800) < 4 * math.sqrt(800 * 0.8)


def test_models_of_bags_differ(spark):
    dice = random.Random(2)
    rows = spark.createDataFrame([(i, dice.gauss(i % 2, 1), dice.gauss(0, 1), i % 2) for i in range(300)], "id long, a double, b double, target int").cache()
    model = pu.bagged(rows, "id", ["a", "b"], models.factory("rf", trees=2, depth=3), bags=3, ratio=0.4)
    seeds = [m.stages[-1].getOrDefault("seed") for m in model.models]
    assert seeds == [43, 44, 45] and len({m.stages[-1].toDebugString.split("\n", 1)[1] for m in model.models}) == 3
    found = model.predict(rows, 0.5)
    assert found.where("predicted <> int(p >= 0.5)").isEmpty() and metrics.auc(found, "p").first()["auc"] > 0.6


# --- selection ---


@pytest.mark.parametrize("ranked", [10, 1_000_000])
def test_threshold_select_is_order_by_limit(spark, monkeypatch, ranked):
    monkeypatch.setattr(select, "RANKED", ranked)
    dice = random.Random(7)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    data = [(i, dice.choice(odd) if i % 9 == 0 else (0.5 if i % 3 else dice.random()), i % 2) for i in range(400)] + [(None, 0.5, 0), (7, 0.5, 1)]
    rows = spark.createDataFrame(data, "id long, v double, g int").repartition(6)
    order = lambda r: (r[1] is None or math.isnan(r[1]), 0 if r[1] is None or math.isnan(r[1]) else r[1] + 0.0, r[0] is not None, r[0] or 0)
    shown = lambda rs: sorted((repr(r[0]), "none" if r[1] is None or math.isnan(r[1]) else repr(r[1] + 0.0)) for r in rs)
    for k in (0, 150, 300, 395, 500):
        got = threshold_select(rows, one_row(rows, k), F.col("v"), ["id"]).collect()
        assert len(got) == min(k, 402)
        assert shown(got) == shown(sorted(data, key=order)[:k]), k
    counts = spark.createDataFrame([(0, 60), (1, 500)], "g int, k long")
    got = threshold_select(rows, counts, F.col("v"), ["id"], ["g"]).collect()
    parts = [sorted((d for d in data if d[2] == g), key=order)[:k] for g, k in ((0, 60), (1, 500))]
    assert shown(got) == shown(parts[0] + parts[1])


def test_one_score_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(select, "RANKED", 200)
    rows = spark.range(3000).select("id", F.lit(1.0).alias("v")).repartition(5)
    assert sorted(r.id for r in select.bottom_fraction(rows, "v", "id", 0.5).collect()) == list(range(1500))


@pytest.mark.parametrize("ranked", [50, 1_000_000])
def test_quantiles_by_segments(spark, monkeypatch, ranked):
    monkeypatch.setattr(select, "RANKED", ranked)
    dice = np.random.default_rng(8)
    for data in (dice.normal(size=3000) ** 3, np.repeat([1.0, 2.0, 3.0], 500), np.append(np.zeros(2000), [1e9, float("inf")])):
        rows = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double").repartition(4)
        at = [0.0, 0.1, 0.5, 0.9, 0.999]
        assert exact_quantiles(rows, "v", at).first()["quantiles"] == pytest.approx(np.quantile(data, at, method="linear").tolist(), rel=1e-12)
        n, found = ranked_values(rows, "v", lambda n: [0, n // 3, n - 1])
        assert n == len(data) and [found[r] for r in (0, n // 3, n - 1)] == [sorted(data)[r] for r in (0, n // 3, n - 1)]


def test_edges_of_kept_sketches(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000 / 20_000).alias("p"), (F.col("id") % 4).alias("batch"))
    edges = zones.sketched_edges(zones.score_sketches(rows, "p", ["batch"]), 5).first()["edges"]
    assert edges == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0], abs=0.005)
    assert zones.sketched_edges(zones.score_sketches(rows.limit(0), "p")).first()["edges"] == []
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scoring.keep_sketches(stream, "p", f"{tmp_path}/kept").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    kept = spark.read.parquet(f"{tmp_path}/kept")
    assert kept.count() == 3 and zones.sketched_edges(kept, 5).first()["edges"] == pytest.approx(edges, abs=0.005)


# --- distances ---


@pytest.mark.parametrize("leaf", [2, 1000])
def test_nearest_points_of_a_crowd(spark, leaf):
    dice = random.Random(9)
    town = [(dice.gauss(0, 1e-3), dice.gauss(0, 1e-3)) for _ in range(150)]
    ref = town + [town[0]] * 30 + [(1000.0, 1000.0), (-500.0, 3.0)]
    asked = [(dice.uniform(-2000, 2000), dice.uniform(-2000, 2000)) for _ in range(40)] + [(dice.gauss(0, 1e-3), 0.0) for _ in range(40)] + town[:5] + [(1e9, -1e9)]
    rows = [(dice.choice([None, 1, 2]), x, y) for x, y in asked + asked[:7]] + [(1, None, 0.0), (None, None, None), (2, float("nan"), 0.0)]
    got = spatial.min_distance(points(spark, rows), points(spark, [(0, x, y) for x, y in ref] + [(1, None, 1.0), (2, float("nan"), 2.0)]), "id", leaf=leaf)
    nearest = lambda x, y: None if x is None or y is None or math.isnan(x) else min(math.hypot(x - a, y - b) for a, b in ref)
    shown = lambda i, x, y, d: (repr(i), repr(x), repr(y), None if d is None else round(d, 6))
    assert Counter(shown(*r) for r in got.collect()) == Counter(shown(i, x, y, nearest(x, y)) for i, x, y in rows)


def test_nearest_points_meet_few(spark):
    """In the crowd each place is measured against some of 3000 points."""
    dice = random.Random(10)
    ref = points(spark, [(i, dice.gauss(0, 1), dice.gauss(0, 1)) for i in range(3000)]).select("x", "y")
    levels, dealt, _ = spatial._tree(ref, 8)
    assert dealt.count() == 3000 and dealt.groupBy("bits", "cell").count().agg(F.max("count")).first()[0] <= 8 and len(levels) > 2


@pytest.mark.parametrize(("leaf", "spread"), [(16, 1e-6), (1, 30.0), (16, 400.0)])
def test_neighbour_sums(spark, leaf, spread):
    dice = random.Random(11)
    data = [(i, dice.gauss(0, spread), dice.gauss(0, spread), i % 3 % 2) for i in range(200)] + [(900, 0.0, 0.0, 1), (900, 0.0, 0.0, 1), (None, 100.0, 0.0, 0), (901, 100.0, 0.0, None), (902, None, 1.0, 1)]
    near = lambda x, y: [t for _, a, b, t in data if a is not None and (x - a) * (x - a) + (y - b) * (y - b) <= 10_000.0]
    rows = points(spark, data, ", target int").repartition(3)
    got = {(r.x, r.y): (r.n, r.w) for r in spatial.neighbour_sums(rows, 100.0, F.col("target"), leaf).collect()}
    assert got == {(x, y): (len(near(x, y)), sum(t or 0 for t in near(x, y))) for _, x, y, _ in data if x is not None}
    assert spatial.fold_census(rows, "id", 100.0).count() == len(data) - 1


# --- folds ---


def test_all_folds_at_once_are_the_refits(spark):
    dice = np.random.default_rng(12)
    n, r = 160, 300.0
    x = np.column_stack([dice.normal(size=(n, 2)) * [1, 40] + [5, 900], np.full(n, 1.5)])
    y = (x[:, 0] - 5 + (x[:, 1] - 900) / 40 + dice.normal(size=n) > 0).astype(int)
    at = dice.uniform(0, 2000, size=(n, 2))
    rows = spark.createDataFrame([(i, *map(float, at[i]), *map(float, x[i]), int(y[i])) for i in range(n)], "id long, x double, y double, a double, b double, c double, target int").repartition(5)
    folds = rows.withColumn("fold", F.col("id"))
    found, _ = newton.fit_folds(folds, ["a", "b", "c"], cv.excluded_folds(folds, "id", r), "id")
    held = {row.id: row.p for row in cv.buffered_logistic(folds, "id", ["a", "b", "c"], r).collect()}
    for i in range(n):
        keep = ((at - at[i]) ** 2).sum(1) > r * r
        mean, sd = x[keep].mean(0), x[keep].std(0, ddof=1)
        inverse = np.divide(1, sd, out=np.zeros(3), where=sd > 1e-9)
        z, t = np.column_stack([(x[keep] - mean) * inverse, np.ones(keep.sum())]), y[keep]
        w, beta = len(t) / (2 * np.bincount(t)[t]), np.zeros(4)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ beta))
            beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0]), z.T @ (w * (p - t)) + np.append(beta[:3], 0))
        assert np.abs(found.fitted[i] - beta).max() < 1e-6
        assert held[i] == pytest.approx(1 / (1 + np.exp(-np.append((x[i] - mean) * inverse, 1) @ beta)), abs=1e-7)


def test_folds_without_a_class(spark):
    rows = spark.createDataFrame([(i, float(i), 0.0, float(i % 3), int(i < 2)) for i in range(8)], "id long, x double, y double, a double, target int")
    whole = rows.withColumn("fold", F.lit(0))
    for out in (cv.buffered_cv(whole, "id", ["a"], models.factory("lr"), 100.0), cv.buffered_logistic(whole, "id", ["a"], 100.0)):
        assert out.columns == ["id", "target", "fold", "p"] and out.count() == 0 and cv.pooled_auc(out).first()["auc"] is None
    some = cv.buffered_logistic(rows.withColumn("fold", (F.col("id") >= 2).cast("int")), "id", ["a"], 1.0)  # training for fold 0 sees one class
    assert some.count() == 0
    aucs = cv.fold_aucs(spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1), (1, 1, 0.5)], "fold int, target int, p double"), 2)
    assert [r.auc for r in aucs.orderBy("fold").collect()] == [1.0, None] and metrics.fold_summary(aucs).first()["folds"] == 1


# --- search and kernels ---


def test_kernel_machine_tells_a_circle_from_a_ring(spark, tmp_path):
    dice, rows = random.Random(13), []
    for i in range(600):
        turn, far = dice.uniform(0, 2 * math.pi), dice.uniform(0, 1) if i % 2 else dice.uniform(1.6, 2.4)
        rows.append((i, far * math.cos(turn), far * math.sin(turn), i % 2))
    data = spark.createDataFrame(rows, "id long, a double, b double, target int").cache()
    seen, held = data.where("id < 400"), data.where("id >= 400")
    score = lambda model: metrics.auc(models.scores(model, held), "p").first()["auc"]
    kernel = models.train(seen, ["a", "b"], "rbf")
    assert score(kernel) > 0.95 and score(models.train(seen, ["a", "b"], "svm")) < 0.75
    models.save(kernel, f"file://{tmp_path}/m")
    assert score(models.load(f"file://{tmp_path}/m")) == pytest.approx(score(kernel))


def test_search_by_kernels_finds_the_ring(spark):
    dice = random.Random(14)
    data = [(i, *(dice.uniform(-1, 1) for _ in range(7))) for i in range(900)]
    rows = spark.createDataFrame([(*r, int(r[2] ** 2 + r[5] ** 2 < 0.6)) for r in data], "id long, a double, b double, c double, d double, e double, f double, g double, target int").cache()
    found = selection.choose(rows, "id", list("abcdefg"), "ga", model="svm", population=12, generations=8)
    assert {"b", "e"} <= set(found.chosen) and len(found.chosen) <= 3 and found.fitness < 0.1
    few = selection._KernelFitness(rows, "id", list("abcdefg"), 3, 1, sample=90)
    assert len(few.table.value[1]) in (90, 91) and few.of([(False,) * 7], 1) == [1e6]
    one = selection._KernelFitness(rows.where("target = 1"), "id", list("ab"), 3, 1)
    assert one.of([(True, True)], 1) == [1e6]
    score, y = np.array([0.1, 0.4, 0.4, 0.9]), np.array([0, 0, 1, 1])
    assert selection._auc_of(score, y) == pytest.approx(0.875)


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(tables, "_made", {})
    rows = tables.saved(spark.range(3))
    [path] = [p for ps in tables._made.values() for p in ps]
    folder = Path(path.removeprefix("file://"))
    assert rows.count() == 3 and folder.exists() and tables.clear_scratch(spark) == 1 and not folder.exists() and tables.clear_scratch(spark) == 0


def test_broken_search_fails(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3), i % 2) for i in range(60)], "id long, a double, b double, target int")
    monkeypatch.setattr(selection, "scores", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        selection.genetic(rows, "id", ["a", "b"], models.factory("cart", depth=2), population=2, generations=1)


# --- sources and sinks ---


def test_three_systems_are_one_place(spark, tmp_path):
    spots = [(92.1, 23.4), (93.0, 24.0), (95.9, -11.0)]
    rows = spark.createDataFrame([(i, lon, lat) for i, (lon, lat) in enumerate(spots)], "point_id long, lon double, lat double")
    north, far, south = utm("lon", "lat", 46), utm("lon", "lat", 45), utm("lon", "lat", 47, False)
    parts = [rows.select("point_id", x.alias("x"), y.alias("y"), F.lit(code).alias("crs")) for (x, y), code in ((north, "EPSG:32646"), ((F.col("lon"), F.col("lat")), "epsg:4326 "), (far, "EPSG:32645"), (south, "EPSG:32747"))]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    tables.write(table, f"{tmp_path}/points")
    for code in ("EPSG:32646", "EPSG:4326"):
        got = tables.scan_points(spark, f"{tmp_path}/points", code)
        assert {r.crs for r in got.collect()} == {code}
        spread = got.groupBy("point_id").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), F.count("*").alias("n")).collect()
        assert all(r.n == 4 and r.dx < 1e-3 and r.dy < 1e-3 for r in spread)
    lon, lat = degrees("x", "y", 46)
    back = parts[0].select(lon.alias("lon"), lat.alias("lat"), "point_id").orderBy("point_id").collect()
    assert [(r.lon, r.lat) for r in back] == [(pytest.approx(a, abs=1e-8), pytest.approx(b, abs=1e-8)) for a, b in spots]
    for wrong in (None, "EPSG:3857", "EPSG:32661", "x"):
        with pytest.raises(ValueError, match="Unknown reference"):
            tables.reprojected_points(parts[0].withColumn("crs", F.lit(wrong).cast("string")), "EPSG:32646")


def test_runs_are_kept_apart(spark, tmp_path):
    report = lambda run, v: metrics.long_metrics(spark.createDataFrame([(v,)], "auc double"), run, "lr", "kfold")
    for run, v in (("a", 0.5), ("b", 0.6), ("a", 0.7)):
        tables.write_runs(report(run, v), f"{tmp_path}/runs")
    assert sorted((r.run_id, r.value) for r in spark.read.parquet(f"{tmp_path}/runs").collect()) == [("a", 0.7), ("b", 0.6)]


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_tiles_are_sampled_as_pixels(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr("scarpline.sources.tiles.SENT", sent)
    pixel = spark.createDataFrame([(layer, r, c, float((r * c) % 7) if (r + c) % 5 else float("nan")) for layer in ("p", "q") for r in range(40) for c in range(40)], "layer string, row int, col int, value double")
    meta = spark.createDataFrame([("p", 0.0, 400.0, 10.0, 10.0, 3.0), ("q", 0.0, 800.0, 20.0, 20.0, None)], "layer string, x0 double, y0 double, px double, py double, nodata double")
    store = write_tiles(pixel, f"{tmp_path}/tiles", 2, (2, 4))
    asked = points(spark, [(i % 50, float(i * 37 % 500) - 50, float(i * 91 % 900) - 50) for i in range(60)] + [(77, None, 1.0)])
    one, other = (sorted(map(repr, map(tuple, pixels.sample_layers(asked, "id", p, meta).collect()))) for p in (pixel, store))
    assert one == other and len(one) == 122
    for stride in (1, 4, 6):
        one, other = (sorted(map(tuple, pixels.valid_pixels(p, meta, "q", stride).collect())) for p in (pixel, Tiles(spark, f"{tmp_path}/tiles", 2)))
        assert one == other and one
    near = points(spark, [(1, 5.0, 395.0)])
    plan = pixels.sample_layers(near, "id", store, meta, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert any("tile" in part[:300] for part in plan.split("PartitionFilters: [")[1:])  # other tiles aren't listed
    assert pixels.sample_layers(near.limit(0), "id", store, meta).count() == 0
    order = spark.range(16).select(morton(F.shiftright("id", 2).cast("int"), (F.col("id") % 4).cast("int")).alias("m")).collect()
    assert sorted(r.m for r in order) == list(range(16)) and [r.m for r in order][:4] == [0, 1, 4, 5]
