"""The registered queries: operators applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions.scalars import AXIS, EAST, FLATTENING, UTM_SCALE, portable_hash, reclass_edges, utm, z_score
from scarpline.operators import cv, fr, metrics, models, pixels, pu, sampling, scaling, selection, spatial, zones
from scarpline.operators.select import bottom_fraction, exact_quantiles
from scarpline.plans import jobs, views
from scarpline.plans.views import CLASSES, candidate, labelled, layer_meta, pixel, presence, px, read, scored
from scarpline.sources import tables, tiles

FEATURES = ["f1", "f2", "f3"]
REGISTRY = "column string, factor string, layer string"
Query = Callable[[SparkSession, str], DataFrame]


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return fr.fr_table(fr.long_classes(px(spark, d), CLASSES, ["hit"]))


def fr_table(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return _weights(spark, d).select("factor", "class", "S_i", "N_i_all", r("area_pct"), r("FR"), r("FRn"), "FR_gt_1")


def fr_source_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = fr.source_stats(px(spark, d), F.col("qty_class"), "l_quantity")
    return stats.select("class", F.col("src_min").cast("double").alias("src_min"), F.col("src_max").cast("double").alias("src_max"), F.round(F.col("src_mean").cast("double"), 6).alias("src_mean"))


def fr_split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = px(spark, d).withColumn("early", (F.col("tax_class") < 4).cast("int"))
    return fr.fr_table(fr.long_classes(rows, {"qty": "qty_class"}, ["hit", "early"]), train="early").select("class", "N_i_train", "N_i_all", F.round("FR", 9).alias("FR"))


def quantile_reclass(spark: SparkSession, d: str) -> DataFrame:
    rows = px(spark, d).select(F.col("l_extendedprice").cast("double").alias("v"))
    edges = exact_quantiles(rows, "v", [0.2, 0.4, 0.6, 0.8]).withColumnRenamed("quantiles", "e")
    return rows.crossJoin(F.broadcast(edges)).groupBy(reclass_edges("v", F.col("e")).alias("class")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def fr_lookup(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d).where("not (factor = 'qty' and class = 3)")
    rows = px(spark, d).select(F.lit("qty").alias("factor"), (F.col("qty_class") + 0.25).alias("value"))
    return fr.fr_lookup(rows, weights).groupBy("value").agg(F.count("*").alias("n"), F.round(F.max("FR"), 9).alias("FR"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return fr.index_map(px(spark, d), tables.saved(_weights(spark, d)), CLASSES)


def lsi_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy(*CLASSES.values()).agg(F.count("*").alias("n"), F.round(F.max("lsi"), 9).alias("lsi"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return zones.zoned(tables.saved(_index(spark, d).select("hit", F.round("lsi", 9).alias("lsi"))), "lsi")


def lsi_zones(spark: SparkSession, d: str) -> DataFrame:
    found = zones.zone_distribution(_zones(spark, d), "lsi")
    return found.select("zone_id", "zone_label", "n", F.round("percent", 9).alias("percent"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


def zone_capture(spark: SparkSession, d: str) -> DataFrame:
    found = zones.zone_capture(_zones(spark, d))
    return found.select("zone_id", "area", "hits", *(F.round(c, 9).alias(c) for c in ("area_share", "hit_share", "area_upto", "hit_upto")))


def success_auc(spark: SparkSession, d: str) -> DataFrame:
    return zones.success_auc(zones.zone_capture(_zones(spark, d))).select(F.round("auc", 9).alias("auc"))


def check_nulls(spark: SparkSession, d: str) -> DataFrame:
    return tables.null_census(labelled(spark, d).withColumn("f2", F.when(F.col("f2") > 3, F.col("f2"))), FEATURES)


def check_domain(spark: SparkSession, d: str) -> DataFrame:
    return tables.domain_census(labelled(spark, d), "f2")


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return tables.dataset_summary(labelled(spark, d)).withColumn("ratio", F.round("ratio", 9))


def target_means(spark: SparkSession, d: str) -> DataFrame:
    return tables.target_means(labelled(spark, d), FEATURES)


def feature_ranges(spark: SparkSession, d: str) -> DataFrame:
    return tables.feature_ranges(labelled(spark, d), FEATURES)


def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("f1", F.when(F.col("f1") > 0, F.col("f1")).otherwise(F.lit(float("nan"))))
    return tables.ordered(tables.complete(rows, FEATURES), FEATURES)


def missing_layers(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("a", "size"), ("b", "brand"), ("c", "slope")], "column string, layer string")
    return tables.missing_layers(registry, pixel(spark, d)).select("layer", "column")


def missing_factors(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("a", "qty"), ("b", "geology")], "column string, factor string")
    return tables.missing_factors(registry, _weights(spark, d)).select("factor", "column")


def valid_pixel_pool(spark: SparkSession, d: str) -> DataFrame:
    found = [pixels.valid_pixels(pixel(spark, d), layer_meta(spark, d), layer, 2).withColumn("layer", F.lit(layer)) for layer in ("size", "brand")]
    return found[0].unionByName(found[1])


def sample_layers(spark: SparkSession, d: str) -> DataFrame:
    values = pixels.sample_layers(labelled(spark, d), "id", pixel(spark, d), layer_meta(spark, d))
    return values.groupBy("id").pivot("layer", ["size", "brand"]).agg(F.first("value"))


def sample_stack(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("qty_fr", "qty", "size"), ("tax_fr", "tax", "brand")], REGISTRY)
    stack = pixels.sample_stack(labelled(spark, d), "id", pixel(spark, d), layer_meta(spark, d), registry, _weights(spark, d), ["qty_fr", "tax_fr"])
    return tables.complete(stack, ["qty_fr", "tax_fr"]).select("id", "x", "y", F.round("qty_fr", 9).alias("qty_fr"), F.round("tax_fr", 9).alias("tax_fr"))


def tiled_stack(spark: SparkSession, d: str) -> DataFrame:
    """``sample_stack`` from a store of tiles."""
    registry = spark.createDataFrame([("qty_fr", "qty", "size"), ("tax_fr", "tax", "brand")], REGISTRY)
    store = tiles.write_tiles(pixel(spark, d), tables.scratch(spark, "tiles"), 4)
    stack = pixels.sample_stack(labelled(spark, d), "id", store, layer_meta(spark, d), registry, _weights(spark, d), ["qty_fr", "tax_fr"])
    return tables.complete(stack, ["qty_fr", "tax_fr"]).select("id", "x", "y", F.round("qty_fr", 9).alias("qty_fr"), F.round("tax_fr", 9).alias("tax_fr"))


def prediction_grid(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("qty_fr", "qty", "size"), ("tax_fr", "tax", "brand")], REGISTRY)
    study = tables.Study(features=("qty_fr", "tax_fr"), grid_stride=2)
    grid = jobs.prediction_grid(pixel(spark, d), layer_meta(spark, d), registry, tables.saved(_weights(spark, d)), study, "size")
    return grid.select("x", "y", F.round("qty_fr", 9).alias("qty_fr"), F.round("tax_fr", 9).alias("tax_fr"))


def training_table(spark: SparkSession, d: str) -> DataFrame:
    """Presences on the pixel grid, as many pseudo-absences 700 m away from them."""
    registry = spark.createDataFrame([("qty_fr", "qty", "size")], REGISTRY)
    study = tables.Study(features=("qty_fr",), buffer=700.0, pool_stride=1)
    weights = tables.saved(_weights(spark, d))
    stacked = pixels.sample_stack(presence(spark, d), "id", pixel(spark, d), layer_meta(spark, d), registry, weights, ["qty_fr"])
    points = tables.saved(stacked.where("qty_fr is not null").select(F.col("id").alias("point_id"), "x", "y"))
    found = jobs.training_table(points, pixel(spark, d), layer_meta(spark, d), registry, weights, study, "size")
    return found.select("x", "y", F.round("qty_fr", 9).alias("qty_fr"), "target")


def min_distance(spark: SparkSession, d: str) -> DataFrame:
    return spatial.min_distance(candidate(spark, d), presence(spark, d), "id").select("id", F.round("distance", 6).alias("distance"))


def buffer_anti(spark: SparkSession, d: str) -> DataFrame:
    return spatial.away_from(candidate(spark, d), presence(spark, d), 500.0)


def buffer_ring(spark: SparkSession, d: str) -> DataFrame:
    return spatial.ring(candidate(spark, d), presence(spark, d), 500.0, 2000.0)


def buffer_control(spark: SparkSession, d: str) -> DataFrame:
    return spatial.buffer_control(labelled(spark, d), 300.0, 2500.0, some=False).select("id", "target")


def distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_summary(presence(spark, d), candidate(spark, d), "id", 1000.0)


def pseudo_absence_topn(spark: SparkSession, d: str) -> DataFrame:
    near = presence(spark, d)
    absent = sampling.pseudo_absences(candidate(spark, d), near, "id", 1000, 500.0, 42, exact=False).withColumn("target", F.lit(0))
    return near.withColumn("target", F.lit(1)).unionByName(absent)


def fold_census(spark: SparkSession, d: str) -> DataFrame:
    return spatial.fold_census(labelled(spark, d), "id", 2000.0)


def buffered_fold_membership(spark: SparkSession, d: str) -> DataFrame:
    return cv.fold_membership(sampling.stratified_folds(labelled(spark, d), "id", 5, 42), "id", 300.0)


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_folds(labelled(spark, d), "id", 5, 42).select("id", "target", "fold")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return scaling.class_weights(labelled(spark, d)).select("target", "n", F.round("weight", 9).alias("weight"))


def positive_weight(spark: SparkSession, d: str) -> DataFrame:
    return scaling.positive_weight(labelled(spark, d)).select(F.round("scale_pos_weight", 9).alias("scale_pos_weight"))


def zscore_stats(spark: SparkSession, d: str) -> DataFrame:
    return scaling.scaler_stats(labelled(spark, d), FEATURES).select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def zscores(spark: SparkSession, d: str) -> DataFrame:
    return scaling.scaled(labelled(spark, d), FEATURES).select("id", *(F.round(c, 6).alias(c) for c in FEATURES))


def pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scaling.pearson(labelled(spark, d), FEATURES).select("a", "b", F.round("r", 9).alias("r"))


def correlated_features(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("f4", F.col("f1") * 2 + F.col("f2"))
    kept, dropped = scaling.correlated(rows, [*FEATURES, "f4"])
    return spark.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "feature string, kept boolean")


def bag_draws(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bag_draws(labelled(spark, d), "id", 5, 42)


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d), F.col("score") >= 25)


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.class_metrics(scored(spark, d), F.col("score") >= 25)
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(scored(spark, d), "score").select(F.round("auc", 9).alias("auc"))


def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_points(scored(spark, d), "score").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return bottom_fraction(scored(spark, d), "score", "id", 0.75).select("id", "score")


def utm_projection(spark: SparkSession, d: str) -> DataFrame:
    """Longitudes and latitudes around the study area, projected to zone 46."""
    rows = candidate(spark, d).select("id", (92 + F.col("id") % 1000 / 1000).alias("lon"), (23 + F.col("id") % 777 / 777).alias("lat"))
    x, y = utm("lon", "lat", 46)
    return rows.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def reprojected_points(spark: SparkSession, d: str) -> DataFrame:
    """The places of ``utm_projection`` given as degrees, in the neighbouring zone and in zone 46 by turns, all brought to zone 46."""
    rows = candidate(spark, d).select("id", (92 + F.col("id") % 1000 / 1000).alias("lon"), (23 + F.col("id") % 777 / 777).alias("lat"))
    systems = [("EPSG:4326", (F.col("lon"), F.col("lat"))), ("EPSG:32645", utm("lon", "lat", 45)), ("EPSG:32646", utm("lon", "lat", 46))]
    turn = lambda values: F.get(F.array(*values), (F.col("id") % 3).cast("int"))
    given = rows.select("id", *(turn([at[i] for _, at in systems]).alias(n) for i, n in enumerate("xy")), turn([F.lit(c) for c, _ in systems]).alias("crs"))
    return tables.reprojected_points(given, "EPSG:32646").select("id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


def zscore_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    stats = rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return rows.crossJoin(F.broadcast(stats)).select("id", F.round(z_score("score", F.col("m"), F.col("s")), 6).alias("z"))


def random_absences(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_absences(presence(spark, d), ["f1"], 200, (520000.0, 545000.0), (2580000.0, 2610000.0), 500.0)


def _small() -> dict[str, dict]:
    return {"rf": {"trees": 20, "depth": 6}, "lr": {}, "gbt": {"rounds": 8, "depth": 3}}


def _trained(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = labelled(spark, d)
        model = models.train(rows, FEATURES, name, **_small()[name])
        return models.scores(model, rows).select("id", "target", "p")

    query.__name__ = f"train_{name}"
    return query


def cart_ranking(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(selection.ranked(labelled(spark, d), FEATURES), "feature string, importance double")


def kfold_cv(spark: SparkSession, d: str) -> DataFrame:
    folds = cv.stratified_cv(labelled(spark, d), "id", FEATURES, models.factory("rf", trees=10, depth=4), 3)
    return folds.unionByName(metrics.fold_summary(folds).select(F.lit(-1).alias("fold"), F.col("mean").alias("auc")))


def buffered_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.block_folds(labelled(spark, d), 8000.0, 3)
    return cv.buffered_cv(rows, "id", FEATURES, models.factory("lr"), 300.0)


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each row by the logistic fit on all rows that are more than 300 m away."""
    rows = labelled(spark, d).withColumn("fold", F.col("id"))
    return cv.buffered_logistic(rows, "id", FEATURES, 300.0).select("id", "target", "p")


def pu_refine(spark: SparkSession, d: str) -> DataFrame:
    return pu.refine(labelled(spark, d), "id", FEATURES, models.factory("rf", trees=5, depth=4), 0.75, bags=2).select("id", "target")


def ga_select(spark: SparkSession, d: str) -> DataFrame:
    """Seven features, of which a ring in the plane of the first two decides; the search has its defaults, with kernel machines."""
    k = F.col("c_custkey")
    unit = lambda i: portable_hash(k, i) / float(1 << 31) * 2 - 1
    rows = read(spark, d, "customer").select(k.alias("id"), unit(1).alias("f1"), unit(2).alias("f2"), unit(3).alias("f3"), F.col("c_acctbal").cast("double").alias("f4"), F.col("c_nationkey").cast("double").alias("f5"), unit(6).alias("f6"), F.length("c_mktsegment").cast("double").alias("f7"))
    rows = rows.withColumn("target", (F.col("f1") * F.col("f1") + F.col("f2") * F.col("f2") < 0.6).cast("int"))
    chosen = selection.choose(tables.saved(rows), "id", [f"f{i}" for i in range(1, 8)], "ga", model="svm")
    return spark.createDataFrame([(c, chosen.fitness) for c in chosen.chosen], "feature string, fitness double")


def score_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return jobs.scored_grid(rows, models.train(rows, FEATURES, "rf", trees=10, depth=4)).select("x", "y", "zone_id", "zone_label", "lsi_prob")


def presence_only(spark: SparkSession, d: str) -> DataFrame:
    """The whole job on presences alone: random negatives, refinement, choice of features, three models, both kinds of folds, zones of a grid."""
    rows = presence(spark, d).select("id", "x", "y", (F.col("id") % 7 / 7).alias("f1"), (F.col("id") % 11 / 10).alias("f2"), (F.col("id") % 3 / 3).alias("f3"), F.lit(1).alias("target"))
    grid = candidate(spark, d).select("x", "y", (F.col("id") % 13 / 10).alias("f1"), (F.col("id") % 17 / 12).alias("f2"), (F.col("id") % 5 / 4).alias("f3"))
    study = tables.Study(features=tuple(FEATURES), folds=2, bags=2, buffer=300.0)
    options = {"rf": {"trees": 10, "depth": 4}, "lr": {"rounds": 20}, "gbt": {"rounds": 4, "depth": 3}}
    found = jobs.susceptibility(rows, "id", study, method="cart", refine=True, block=8000.0, grid=grid, options=options)
    shares = found["distribution"].select(F.lit("run").alias("run_id"), F.lit("rf").alias("model"), F.lit("zones").alias("scheme"), "zone_id", F.col("zone_label").alias("metric"), F.col("percent").alias("value"))
    return found["metrics"].unionByName(shares.withColumnRenamed("zone_id", "fold"))


def presence_only_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each class the job's steps before the models leave: random negatives, then the share that refinement keeps."""
    rows = presence(spark, d).select("id", "x", "y", (F.col("id") % 7 / 7).alias("f1"), F.lit(1).alias("target"))
    built = tables.saved(sampling.with_absences(rows, ["f1"], x=(500_000.0, 560_000.0), y=(2_560_000.0, 2_630_000.0), buffer=300.0)).withColumn("id", F.xxhash64("x", "y", "target"))
    kept = pu.refine(built, "id", ["f1"], models.factory("rf", trees=5, depth=3), 0.75, bags=2)
    return kept.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def ml_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole job on labelled rows: three models, five folds, folds with a buffer (for logistic regression each row), fits and report."""
    study = tables.Study(features=tuple(FEATURES), fold_radius=300.0)
    return jobs.susceptibility(labelled(spark, d), "id", study, block=8000.0, leave_one_out=True, options=_small())["metrics"]


NATIVE: tuple[Query, ...] = (
    fr_table, fr_source_stats, fr_split_counts, quantile_reclass, fr_lookup, lsi_index, lsi_zones, zone_capture, success_auc, check_nulls, check_domain, dataset_summary, target_means, feature_ranges, complete_rows,
    missing_layers, missing_factors, valid_pixel_pool, sample_layers, sample_stack, tiled_stack, prediction_grid, training_table, min_distance, buffer_anti, buffer_ring, buffer_control, distance_pairs, pseudo_absence_topn,
    fold_census, buffered_fold_membership, stratified_folds, class_weights, positive_weight, zscore_stats, zscores, pearson_matrix, correlated_features, bag_draws, confusion, class_metrics, auc_exact, roc_points,
    bottom_k, utm_projection, reprojected_points, zscore_grid, random_absences,
)
MODELS: tuple[Query, ...] = (_trained("rf"), _trained("lr"), _trained("gbt"), cart_ranking, kfold_cv, buffered_cv, leave_one_out, pu_refine, ga_select, score_grid, ml_pipeline, presence_only, presence_only_rows)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*NATIVE, *MODELS)}


_FR = """, cls AS (SELECT 'qty' AS factor, qty_class AS class, hit FROM px UNION ALL SELECT 'disc', disc_class, hit FROM px UNION ALL SELECT 'tax', tax_class, hit FROM px),
 cnt AS (SELECT factor, class, count(*) AS S_i, sum(hit) AS N_i FROM cls GROUP BY ALL),
 fr AS (SELECT factor, class, S_i, N_i, 100.0*S_i/sum(S_i) OVER (PARTITION BY factor) AS area_pct,
   (N_i/sum(N_i) OVER (PARTITION BY factor))/(S_i/sum(S_i) OVER (PARTITION BY factor)) AS FR FROM cnt)"""
_LSI = _FR + """, lsi AS (SELECT p.*, round(a.FR+b.FR+c.FR, 9) AS lsi FROM px p JOIN fr a ON a.factor='qty' AND a.class=qty_class JOIN fr b ON b.factor='disc' AND b.class=disc_class JOIN fr c ON c.factor='tax' AND c.class=tax_class),
 e0 AS (SELECT quantile_cont(lsi, [0,0.2,0.4,0.6,0.8,1.0]) AS q FROM lsi), e AS (SELECT list_distinct(q) AS edges FROM e0),
 z AS (SELECT lsi.*, CAST(greatest(len(list_filter(edges, lambda x: x < lsi))-1, 0) AS INT) AS zone_id FROM lsi, e)"""
_CAP = _LSI + """, cap AS (SELECT zone_id, count(*) AS area, CAST(sum(hit) AS BIGINT) AS hits FROM z GROUP BY 1),
 sh AS (SELECT *, area/sum(area) OVER () AS area_share, hits/sum(hits) OVER () AS hit_share FROM cap),
 up AS (SELECT *, sum(area_share) OVER (ORDER BY zone_id DESC) AS area_upto, sum(hit_share) OVER (ORDER BY zone_id DESC) AS hit_upto FROM sh)"""
_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"
_STACK = _FR + """, smp AS (SELECT l.id, l.x, l.y, m.layer, CASE WHEN abs(p.value-m.nodata)<0.001 THEN NULL ELSE p.value END AS v FROM labelled l CROSS JOIN layer_meta m
   LEFT JOIN pixel p ON p.layer=m.layer AND p."row"=CAST(floor((m.y0-l.y)/m.py) AS INT) AND p.col=CAST(floor((l.x-m.x0)/m.px) AS INT))"""


def _hash_sql(key: str, seed: str) -> str:
    """``portable_hash`` in SQL."""
    whole, stirred = 1 << 31, "lambda x: xor(x, x >> 16) * 73244475 % 2147483648"
    low = f"(CAST({key} AS BIGINT) % {whole} + (CAST({key} AS BIGINT) >> 31) % {whole} * 1103515245 + (CAST({key} AS BIGINT) >> 62) * 715225739) % {whole}"
    return f"list_transform(list_transform(list_transform(list_transform([{low}], {stirred}), lambda x: (x + CAST({seed} AS BIGINT) * 1566083941 % {whole}) % {whole}), {stirred}), {stirred})[1]"


_FOLDS = f", f AS (SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY {_hash_sql('id', '42')}, id)-1)%5 AS INT) AS fold FROM labelled)"
_ROC = """, g AS (SELECT score, count(*) FILTER (target=1) AS pos, count(*) FILTER (target=0) AS neg FROM scored GROUP BY 1),
 c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS up_pos, sum(neg) OVER (ORDER BY score DESC) AS up_neg, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)"""

def _utm_sql(zone: int, places: int = 3) -> str:
    """Krueger's series in SQL over ``lon`` and ``lat``: a SELECT list of id, x and y."""
    n = FLATTENING / (2 - FLATTENING)
    radius, c = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    east = " + ".join(f"({k!r})*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, k in enumerate(alpha, 1))
    north = " + ".join(f"({k!r})*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, k in enumerate(alpha, 1))
    return f""", g AS (SELECT id, 92 + id%1000/1000 AS lon, 23 + id%777/777 AS lat FROM candidate), s AS (SELECT id, sin(radians(lat)) AS s, radians(lon - {zone * 6 - 183}) AS dl FROM g),
     t AS (SELECT id, dl, sinh(atanh(s) - {c!r}*atanh({c!r}*s)) AS t FROM s), e AS (SELECT id, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM t),
     u AS (SELECT id, round({EAST} + {UTM_SCALE * radius!r}*(eta + {east}), {places}) AS x, round({UTM_SCALE * radius!r}*(xi + {north}), {places}) AS y FROM e)"""


#: Query: the views it uses, common tables after them, and the final SELECT.
_SQL: dict[str, tuple[str, str, str]] = {
    "fr_table": ("px", _FR, "SELECT factor, class, S_i, CAST(N_i AS BIGINT) AS N_i_all, round(area_pct,9) AS area_pct, round(FR,9) AS FR, round(FR/max(FR) OVER (PARTITION BY factor),9) AS FRn, FR>1 AS FR_gt_1 FROM fr"),
    "fr_source_stats": ("px", "", "SELECT qty_class AS class, CAST(min(l_quantity) AS DOUBLE) AS src_min, CAST(max(l_quantity) AS DOUBLE) AS src_max, round(CAST(avg(l_quantity) AS DOUBLE),6) AS src_mean FROM px GROUP BY 1"),
    "fr_split_counts": ("px", ", c AS (SELECT qty_class AS class, count(*) AS s, count(*) FILTER (hit=1 AND tax_class<4) AS t, sum(hit) AS a FROM px GROUP BY 1)", "SELECT class, t AS N_i_train, CAST(a AS BIGINT) AS N_i_all, round((t/sum(t) OVER ())/(s/sum(s) OVER ()),9) AS FR FROM c"),
    "quantile_reclass": ("px", ", v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM px), e AS (SELECT quantile_cont(v,[0.2,0.4,0.6,0.8]) AS q FROM v)", "SELECT CAST(len(list_filter(q, lambda x: x < v))+1 AS INT) AS class, count(*) AS n, min(v) AS least, max(v) AS most FROM v, e GROUP BY 1"),
    "fr_lookup": ("px", _FR, "SELECT CAST(qty_class+0.25 AS DOUBLE) AS value, count(*) AS n, round(max(fr.FR),9) AS FR FROM px LEFT JOIN fr ON fr.factor='qty' AND fr.class=qty_class AND fr.class<>3 GROUP BY 1"),
    "lsi_index": ("px", _LSI, "SELECT qty_class, disc_class, tax_class, count(*) AS n, max(lsi) AS lsi FROM lsi GROUP BY ALL"),
    "lsi_zones": ("px", _LSI, "SELECT CAST(i AS INT) AS zone_id, ['Very Low','Low','Moderate','High','Very High'][i+1] AS zone_label, count(z.lsi) AS n, round(100.0*count(z.lsi)/(SELECT count(*) FROM z),9) AS percent, round(min(z.lsi),6) AS least, round(max(z.lsi),6) AS most FROM range(5) t(i) LEFT JOIN z ON z.zone_id=i GROUP BY i"),
    "zone_capture": ("px", _CAP, "SELECT zone_id, area, hits, round(area_share,9) AS area_share, round(hit_share,9) AS hit_share, round(area_upto,9) AS area_upto, round(hit_upto,9) AS hit_upto FROM up"),
    "success_auc": ("px", _CAP + ", s AS (SELECT *, coalesce(lag(area_upto) OVER (ORDER BY zone_id DESC),0) AS a0, coalesce(lag(hit_upto) OVER (ORDER BY zone_id DESC),0) AS h0 FROM up)", "SELECT round(sum((area_upto-a0)*(hit_upto+h0)/2),9) AS auc FROM s"),
    "check_nulls": ("labelled", "", "SELECT 'f1' AS feature, count(*) FILTER (f1 IS NULL) AS nulls FROM labelled UNION ALL SELECT 'f2', count(*) FILTER (f2<=3) FROM labelled UNION ALL SELECT 'f3', 0 FROM (SELECT 1)"),
    "check_domain": ("labelled", "", "SELECT count(*) AS rows, count(*) FILTER (f2 NOT IN (0,1)) AS bad FROM labelled"),
    "dataset_summary": ("labelled", "", "SELECT count(*) AS n, count(*) FILTER (target=1) AS n_pos, count(*) FILTER (target=0) AS n_neg, round(count(*) FILTER (target=1)/count(*) FILTER (target=0),9) AS ratio FROM labelled"),
    "target_means": ("labelled", "", "SELECT target, round(avg(f1),4) AS f1, round(avg(f2),4) AS f2, round(avg(f3),4) AS f3 FROM labelled GROUP BY 1"),
    "feature_ranges": ("labelled", "", "SELECT 'f1' AS feature, count(f1) AS n_valid, min(f1) AS least, max(f1) AS most FROM labelled UNION ALL SELECT 'f2', count(f2), min(f2), max(f2) FROM labelled UNION ALL SELECT 'f3', count(f3), min(f3), max(f3) FROM labelled"),
    "complete_rows": ("labelled", "", "SELECT x, y, f1, f2, f3, target FROM labelled WHERE f1>0"),
    "missing_layers": ("pixel", "", "SELECT layer, \"column\" FROM (VALUES ('a','size'),('b','brand'),('c','slope')) t(\"column\",layer) WHERE layer NOT IN (SELECT layer FROM pixel)"),
    "missing_factors": ("px", _FR, "SELECT factor, \"column\" FROM (VALUES ('a','qty'),('b','geology')) t(\"column\",factor) WHERE factor NOT IN (SELECT factor FROM fr)"),
    "valid_pixel_pool": ("pixel layer_meta", "", "SELECT layer, p.\"row\", p.col, CAST(m.x0+(p.col+0.5)*m.px AS DOUBLE) AS x, CAST(m.y0-(p.\"row\"+0.5)*m.py AS DOUBLE) AS y FROM pixel p JOIN layer_meta m USING (layer) WHERE value>0 AND (m.nodata IS NULL OR value<>m.nodata) AND p.\"row\"%2=0 AND p.col%2=0"),
    "sample_layers": ("px labelled pixel layer_meta", _STACK, "SELECT id, max(v) FILTER (layer='size') AS size, max(v) FILTER (layer='brand') AS brand FROM smp GROUP BY id"),
    "sample_stack": ("px labelled pixel layer_meta", _STACK, "SELECT s.id, s.x, s.y, round(a.FR,9) AS qty_fr, round(b.FR,9) AS tax_fr FROM smp s JOIN fr a ON s.layer='size' AND a.factor='qty' AND a.class=CAST(s.v AS INT) JOIN smp t ON t.id=s.id AND t.layer='brand' JOIN fr b ON b.factor='tax' AND b.class=CAST(t.v AS INT)"),
    "prediction_grid": ("px pixel layer_meta", _FR + """, g AS (SELECT m.x0+(p.col+0.5)*m.px AS x, m.y0-(p."row"+0.5)*m.py AS y, p.value FROM pixel p JOIN layer_meta m USING (layer) WHERE layer='size' AND p.value>0 AND p.value<>m.nodata AND p."row"%2=0 AND p.col%2=0)""",
        "SELECT CAST(g.x AS DOUBLE) AS x, CAST(g.y AS DOUBLE) AS y, round(a.FR,9) AS qty_fr, round(b.FR,9) AS tax_fr FROM g JOIN layer_meta m ON m.layer='brand' JOIN pixel q ON q.layer='brand' AND q.\"row\"=CAST(floor((m.y0-g.y)/m.py) AS INT) AND q.col=CAST(floor((g.x-m.x0)/m.px) AS INT) JOIN fr a ON a.factor='qty' AND a.class=CAST(g.value AS INT) JOIN fr b ON b.factor='tax' AND b.class=CAST(q.value AS INT)"),
    "training_table": ("px presence pixel layer_meta", _FR + f""", w AS (SELECT * FROM pixel p JOIN layer_meta m USING (layer) JOIN fr ON fr.factor='qty' AND fr.class=CAST(p.value AS INT) WHERE layer='size' AND value>0 AND value<>m.nodata),
      b AS (SELECT s.x, s.y, w.FR FROM presence s JOIN w ON w."row"=CAST(floor((w.y0-s.y)/w.py) AS INT) AND w.col=CAST(floor((s.x-w.x0)/w.px) AS INT)),
      a AS (SELECT w.x0+(w.col+0.5)*w.px AS x, w.y0-(w."row"+0.5)*w.py AS y, w."row", w.col, w.FR FROM w),
      f AS (SELECT a.*, row_number() OVER (ORDER BY {_hash_sql('(CAST(a."row" AS BIGINT)*100003+a.col)', '42')}, a."row", a.col) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_D2} < 490000))""",
        "SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(FR,9) AS qty_fr, 1 AS target FROM b UNION ALL SELECT CAST(x AS DOUBLE), CAST(y AS DOUBLE), round(FR,9), 0 FROM f WHERE n <= (SELECT count(*) FROM b)"),
    "presence_only_rows": ("presence", ", c AS (SELECT count(*) AS n FROM presence)", "SELECT 1 AS target, n, n AS ids FROM c UNION ALL SELECT 0, CAST(greatest(round_even(0.75*n,0),1) AS BIGINT), CAST(greatest(round_even(0.75*n,0),1) AS BIGINT) FROM c"),
    "min_distance": ("candidate presence", "", f"SELECT a.id, round(sqrt(min({_D2})),6) AS distance FROM candidate a, presence b GROUP BY a.id"),
    "buffer_anti": ("candidate presence", "", f"SELECT a.* FROM candidate a WHERE NOT EXISTS (SELECT 1 FROM presence b WHERE {_D2} < 250000)"),
    "buffer_ring": ("candidate presence", "", f"SELECT a.* FROM candidate a WHERE NOT EXISTS (SELECT 1 FROM presence b WHERE {_D2} < 250000) AND EXISTS (SELECT 1 FROM presence b WHERE {_D2} <= 4000000)"),
    "buffer_control": ("labelled", "", f"SELECT id, target FROM labelled WHERE target=1 UNION ALL SELECT a.id, a.target FROM labelled a WHERE a.target=0 AND NOT EXISTS (SELECT 1 FROM labelled b WHERE b.target=1 AND {_D2} < 90000) AND EXISTS (SELECT 1 FROM labelled b WHERE b.target=1 AND {_D2} <= 6250000)"),
    "distance_pairs": ("candidate presence", "", f"SELECT b.id, count(*) AS n, min(a.id) AS first FROM candidate a, presence b WHERE {_D2} <= 1000000 GROUP BY b.id"),
    "pseudo_absence_topn": ("candidate presence", "", f"SELECT *, 1 AS target FROM presence UNION ALL (SELECT a.*, 0 FROM candidate a WHERE NOT EXISTS (SELECT 1 FROM presence b WHERE {_D2} < 250000) ORDER BY {_hash_sql('a.id', '42')}, a.id LIMIT 1000)"),
    "fold_census": ("labelled", f", n AS (SELECT a.id, count(*) AS n_excluded, sum(b.target) AS p FROM labelled a JOIN labelled b ON {_D2} <= 4000000 GROUP BY a.id), t AS (SELECT count(*) AS n, sum(target) AS p FROM labelled)", "SELECT id, n_excluded, t.n-n_excluded AS n_train, CAST(t.p-n.p AS BIGINT) AS n_train_pos, t.p-n.p BETWEEN 1 AND t.n-n_excluded-1 AS usable FROM n, t"),
    "buffered_fold_membership": ("labelled", _FOLDS + f", o AS (SELECT DISTINCT b.id, a.fold FROM f a JOIN f b ON {_D2} <= 90000), oc AS (SELECT fold, count(*) AS c FROM o GROUP BY 1)", "SELECT f.fold, count(*) AS n_test, (SELECT count(*) FROM f)-any_value(oc.c) AS n_train FROM f JOIN oc USING (fold) GROUP BY f.fold"),
    "stratified_folds": ("labelled", _FOLDS, "SELECT id, target, fold FROM f"),
    "class_weights": ("labelled", "", "SELECT target, count(*) AS n, round(sum(count(*)) OVER ()/(count(*) OVER ()*count(*)),9) AS weight FROM labelled GROUP BY target"),
    "positive_weight": ("labelled", "", "SELECT round(greatest(count(*) FILTER (target=0),1)/greatest(count(*) FILTER (target=1),1),9) AS scale_pos_weight FROM labelled"),
    "zscore_stats": ("labelled", ", u AS (SELECT 'f1' AS feature, f1 AS v FROM labelled UNION ALL SELECT 'f2', f2 FROM labelled UNION ALL SELECT 'f3', f3 FROM labelled)", "SELECT feature, round(avg(v),6) AS mean, round(CASE WHEN min(v)=max(v) THEN 0.0 ELSE stddev_pop(v) END,6) AS sd FROM u GROUP BY 1"),
    "zscores": ("labelled", ", s AS (SELECT avg(f1) a1, stddev_pop(f1) s1, avg(f2) a2, stddev_pop(f2) s2 FROM labelled)", "SELECT id, round((f1-a1)/s1,6) AS f1, round((f2-a2)/s2,6) AS f2, CAST(0 AS DOUBLE) AS f3 FROM labelled, s"),
    "pearson_matrix": ("labelled", "", "SELECT 'f1' AS a, 'f2' AS b, round(covar_pop(f1,f2)/(stddev_pop(f1)*stddev_pop(f2)),9) AS r FROM labelled UNION ALL SELECT 'f1','f3',0.0 FROM (SELECT 1) UNION ALL SELECT 'f2','f3',0.0 FROM (SELECT 1)"),
    "correlated_features": ("labelled", ", k AS (SELECT abs(corr(f1, 2*f1+f2))>=0.85 AS d FROM labelled)", "SELECT unnest(['f1','f2','f3']) AS feature, true AS kept UNION ALL SELECT 'f4', NOT d FROM k"),
    "bag_draws": ("labelled", f", r AS (SELECT CAST(b AS INT) AS bag, id, row_number() OVER (PARTITION BY b ORDER BY {_hash_sql('id', '(43+b)')}, id) AS n FROM labelled, range(5) t(b) WHERE target=0), p AS (SELECT count(*) FILTER (target=1) AS k FROM labelled)", "SELECT bag, id FROM r, p WHERE n<=k"),
    "confusion": ("scored", "", "SELECT count(*) FILTER (target=0 AND score<25) AS tn, count(*) FILTER (target=0 AND score>=25) AS fp, count(*) FILTER (target=1 AND score<25) AS fn, count(*) FILTER (target=1 AND score>=25) AS tp FROM scored"),
    "class_metrics": ("scored", ", c AS (SELECT count(*) AS n, count(*) FILTER (target=0 AND score>=25) AS fp, count(*) FILTER (target=1 AND score<25) AS fn, count(*) FILTER (target=1 AND score>=25) AS tp FROM scored)", "SELECT round((n-fp-fn)/n,9) AS accuracy, round(tp/(tp+fp),9) AS precision, round(tp/(tp+fn),9) AS recall, round(2*tp/(2*tp+fp+fn),9) AS f1 FROM c"),
    "auc_exact": ("scored", _ROC, "SELECT round(sum(neg*(up_pos-pos)+neg*pos/2.0)/any_value(P*N),9) AS auc FROM c"),
    "roc_points": ("scored", _ROC, "SELECT score AS threshold, round(up_pos/P,9) AS tpr, round(up_neg/N,9) AS fpr FROM c"),
    "bottom_k": ("scored", ", k AS (SELECT CAST(round_even(0.75*count(*),0) AS BIGINT) AS k FROM scored), r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS n FROM scored)", "SELECT id, score FROM r, k WHERE n<=k"),
    "utm_projection": ("candidate", _utm_sql(46), "SELECT id, x, y FROM u"),
    "reprojected_points": ("candidate", _utm_sql(46, 1), "SELECT id, x, y FROM u"),
    "zscore_grid": ("scored", ", s AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scored)", "SELECT id, round((score-m)/s,6) AS z FROM scored, s"),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (used, more, select) in _SQL.items():
        ctes = ", ".join(f"{v} AS ({views.SQL[v]})" for v in used.split())
        out[name] = f"WITH {ctes}{more} {select}"
    out["tiled_stack"] = out["sample_stack"]
    return out
