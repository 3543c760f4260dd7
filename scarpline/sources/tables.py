"""Scans with explicit schemas, checks of what was scanned, and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from scarpline.functions.scalars import known_system, missing, reprojected

#: The factors of the study, in order. Columns are named <factor>_fr.
FACTORS = ("rainfall", "earthquake", "slope", "elevation", "distance_drainage", "tri", "geomorphology", "geology", "soil", "gravity_anomaly", "distance_faults", "sti", "twi", "spi", "distance_roads", "lulc", "ndvi")
FEATURES = tuple(f"{f}_fr" for f in FACTORS)
#: Labels of the zones, from the lowest.
ZONES = ("Very Low", "Low", "Moderate", "High", "Very High")


@dataclass(frozen=True)
class Study:
    """Parameters of a study, passed to the jobs that need them."""

    features: tuple[str, ...] = FEATURES
    x: tuple[float, float] = (520_000.0, 545_000.0)
    y: tuple[float, float] = (2_580_000.0, 2_610_000.0)
    crs: str = "EPSG:32646"
    buffer: float = 500.0
    outer: float | None = None
    fold_radius: float = 1000.0
    pool_stride: int = 10
    grid_stride: int = 40
    folds: int = 5
    bags: int = 10
    keep_fraction: float = 0.75
    zones: int = 5
    seed: int = 42


def training_schema(features: Sequence[str] = FEATURES, target: bool = True) -> StructType:
    doubles = [StructField(c, DoubleType()) for c in ("x", "y", *features)]
    return StructType(doubles + [StructField("target", IntegerType())] * target)


def fr_schema() -> StructType:
    names = {"factor": StringType(), "factor_title": StringType(), "class": IntegerType(), "label": StringType(), "S_i": LongType(), "area_pct": DoubleType(), "N_i_train": IntegerType(), "N_i_all": IntegerType(), "FR": DoubleType(), "FRn": DoubleType(), "FR_gt_1": BooleanType(), "src_min": DoubleType(), "src_max": DoubleType(), "src_mean": DoubleType()}
    return StructType([StructField(k, t) for k, t in names.items()])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same table; an error names the columns that it lacks. Nothing is read."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"Missing columns: {', '.join(lacking)}")
    return df


def scan(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet, or CSV with a header by the path's end; malformed rows fail."""
    if not path.endswith(".csv"):
        return require_columns(spark.read.parquet(path), schema.fieldNames())
    header = spark.read.option("header", True).csv(path).columns
    require_columns(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)), schema.fieldNames())
    whole = StructType([schema[c] if c in schema.fieldNames() else StructField(c, StringType()) for c in header])
    return spark.read.schema(whole).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_points(spark: SparkSession, path: str, crs: str = "EPSG:32646") -> DataFrame:
    """point_id, x, y (and more columns) in the study's system; each row is reprojected from the one that its ``crs`` names.

    Systems are WGS84 degrees and its UTM zones. A table that names none, and rows with a null or unknown one, are refused.
    """
    points = require_columns(spark.read.parquet(path), ["point_id", "x", "y"])
    if "crs" not in points.columns:
        raise ValueError("The points have no coordinate reference system")
    return reprojected_points(points, crs)


def reprojected_points(points: DataFrame, crs: str) -> DataFrame:
    """The same points with x and y in the system ``crs``, and that as their ``crs``."""
    unknown = [r["crs"] for r in points.where(~known_system("crs")).select("crs").distinct().limit(5).collect()]
    if unknown or not re.fullmatch(r"EPSG:(4326|32[67](0[1-9]|[1-5]\d|60))", crs):
        raise ValueError(f"Unknown reference systems: {unknown or [crs]}")
    x, y = reprojected("x", "y", "crs", crs)
    return points.withColumns({"x": x, "y": y, "crs": F.lit(crs)})


def scan_fr(spark: SparkSession, path: str) -> DataFrame:
    """The table of class weights; (factor, class) is unique."""
    table = require_columns(scan(spark, path, fr_schema()), ["factor", "class", "FR"])
    twice = table.groupBy("factor", "class").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"Classes given twice: {[(r['factor'], r['class']) for r in twice]}")
    return table


def null_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, nulls: how many values are null or NaN, in one pass."""
    counts = df.agg(*(F.count_if(missing(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], list(columns), "feature", "nulls")


def domain_census(df: DataFrame, column: str = "target", allowed: Sequence[int] = (0, 1)) -> DataFrame:
    """rows, bad: how many values are outside the domain (nulls are)."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).alias("bad"))


def validated(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same training table; an error tells of missing columns, null features or a target outside {0, 1}."""
    require_columns(df, ["x", "y", *features, "target"])
    bad = [F.count_if(missing(c).isNull()).alias(c) for c in features]
    row = df.agg(*bad, F.count_if(~F.coalesce(F.col("target").isin(0, 1), F.lit(False))).alias("_target")).first()
    nulls = {c: row[c] for c in features if row[c]}
    if nulls:
        raise ValueError(f"Null values in features: {nulls}")
    if row["_target"]:
        raise ValueError(f"The target column has {row['_target']} values other than 0 and 1")
    return df


def complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature present and finite; NaN becomes null on the way."""
    return df.withColumns({c: missing(c) for c in features}).dropna(how="any", subset=list(features))


def require_complete(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """The same table; an error names up to 20 rows with a missing feature."""
    some = df.where(~_all_present(features)).select(key).limit(20).collect()
    if some:
        raise ValueError(f"Missing features in rows {[r[0] for r in some]}")
    return df


def _all_present(features: Sequence[str]):
    found = F.lit(True)
    for c in features:
        found = found & missing(c).isNotNull()
    return found


def dataset_summary(df: DataFrame) -> DataFrame:
    """n, n_pos, n_neg and ratio n_pos / n_neg, infinite without negatives."""
    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col("target") == 1).alias("n_pos"), F.count_if(F.col("target") == 0).alias("n_neg"))
    return counts.withColumn("ratio", F.when(F.col("n_neg") == 0, F.lit(float("inf"))).otherwise(F.try_divide("n_pos", "n_neg")))


def target_means(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Means of the features by target, to 4 places."""
    return df.groupBy("target").agg(*(F.round(F.avg(c), 4).alias(c) for c in features))


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, n_valid, least, most over present values."""
    values = df.select(*(missing(c).alias(c) for c in features)).unpivot([], list(features), "feature", "value")
    return values.groupBy("feature").agg(F.count("value").alias("n_valid"), F.min("value").alias("least"), F.max("value").alias("most"))


def missing_layers(registry: DataFrame, pixels: DataFrame) -> DataFrame:
    """Registered layers without pixels."""
    return registry.join(pixels.select("layer").distinct(), "layer", "left_anti")


def missing_factors(registry: DataFrame, fr: DataFrame) -> DataFrame:
    """Registered factors without class weights."""
    return registry.join(fr.select("factor").distinct(), "factor", "left_anti")


def ordered(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """x, y, the features, and the target where there is one."""
    return df.select("x", "y", *features, *(["target"] if "target" in df.columns else []))


def write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a data set, grid, score or metrics table, as CSV or Parquet by the path's end."""
    out = df.write.mode("overwrite").partitionBy(*partition_by)
    out.option("header", True).csv(path) if path.endswith(".csv") else out.parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Add the rows of runs (``run_id``) to a table of reports, as Parquet; a run that is there already is replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new folder name for intermediate tables and files below ``spark.checkpoint.dir``, which all executors share.

    Only where a local session has no such setting (tests) is a temporary folder of this machine used; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _local[spark.sparkContext.applicationId] = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}  # temporary folders of local sessions without a setting


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables and files that this session has made so far, and tell how many. Results read from them must have been written before."""
    hadoop, paths = spark.sparkContext._jvm.org.apache.hadoop.fs, _made.pop(spark.sparkContext.applicationId, [])
    gone = [hadoop.Path(p) for p in paths]
    return sum(bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)) for p in gone)


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows as Parquet into shared scratch space and read them back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
