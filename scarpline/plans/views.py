"""The driver's tables seen as pixels, points and scores, for queries and benchmarks; and the same as SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions.scalars import reclass_breaks

BREAKS = [10, 20, 30, 40]
CLASSES = {"qty": "qty_class", "disc": "disc_class", "tax": "tax_class"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_returnflag") == "R").cast("int").alias("hit"), "l_quantity", "l_extendedprice", reclass_breaks(F.col("l_quantity"), BREAKS).alias("qty_class"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc_class"), F.round(F.col("l_tax") * 100).cast("int").alias("tax_class"),
    )


def _placed(df: DataFrame, key: str, *more) -> DataFrame:
    k = F.col(key)
    return df.select(k.alias("id"), (520000 + k * 7919 % 25000).cast("double").alias("x"), (2580000 + k * 104729 % 30000).cast("double").alias("y"), *more)


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(read(spark, sf_dir, "supplier"), "s_suppkey")


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(read(spark, sf_dir, "orders"), "o_orderkey")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.col("c_acctbal").cast("double").alias("f1"), F.col("c_nationkey").cast("double").alias("f2"), F.lit(1.0).alias("f3"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("target"))
    return _placed(read(spark, sf_dir, "customer"), "c_custkey", *more)


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    at = (F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"))
    size = rows.select(F.lit("size").alias("layer"), *at, (1 + F.col("p_size") % 5).cast("double").alias("value"))
    brand = rows.where(F.col("p_partkey") % 7 != 0).select(F.lit("brand").alias("layer"), *at, (1 + F.length("p_name") % 4).cast("double").alias("value"))
    return size.unionByName(brand)


def layer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pixel sizes; the second layer has no nodata value."""
    rows = [("size", 520000.0, 2600000.0, 500.0, 500.0, 3.0), ("brand", 520000.0, 2600000.0, 1000.0, 1000.0, None)]
    return spark.createDataFrame(rows, "layer string, x0 double, y0 double, px double, py double, nodata double")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 10000).cast("double").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))


SQL = {
    "px": """SELECT CAST(l_returnflag='R' AS INT) AS hit, l_quantity, l_extendedprice,
      CASE WHEN l_quantity<10 THEN 1 WHEN l_quantity<20 THEN 2 WHEN l_quantity<30 THEN 3 WHEN l_quantity<40 THEN 4 ELSE 5 END AS qty_class,
      CAST(round(l_discount*100) AS INT) AS disc_class, CAST(round(l_tax*100) AS INT) AS tax_class FROM lineitem""",
    "presence": "SELECT s_suppkey AS id, CAST(520000+(s_suppkey*7919)%25000 AS DOUBLE) AS x, CAST(2580000+(s_suppkey*104729)%30000 AS DOUBLE) AS y FROM supplier",
    "candidate": "SELECT o_orderkey AS id, CAST(520000+(o_orderkey*7919)%25000 AS DOUBLE) AS x, CAST(2580000+(o_orderkey*104729)%30000 AS DOUBLE) AS y FROM orders",
    "labelled": """SELECT c_custkey AS id, CAST(520000+(c_custkey*7919)%25000 AS DOUBLE) AS x, CAST(2580000+(c_custkey*104729)%30000 AS DOUBLE) AS y,
      CAST(c_acctbal AS DOUBLE) AS f1, CAST(c_nationkey AS DOUBLE) AS f2, CAST(1.0 AS DOUBLE) AS f3, CAST(c_mktsegment='BUILDING' AS INT) AS target FROM customer""",
    "pixel": """SELECT 'size' AS layer, CAST(floor(p_partkey/50) AS INT) AS "row", CAST(p_partkey%50 AS INT) AS col, CAST(1+p_size%5 AS DOUBLE) AS value FROM part
      UNION ALL SELECT 'brand', CAST(floor(p_partkey/50) AS INT), CAST(p_partkey%50 AS INT), CAST(1+length(p_name)%4 AS DOUBLE) FROM part WHERE p_partkey%7<>0""",
    "layer_meta": "SELECT * FROM (VALUES ('size',520000.0,2600000.0,500.0,500.0,3.0),('brand',520000.0,2600000.0,1000.0,1000.0,NULL)) t(layer,x0,y0,px,py,nodata)",
    "scored": "SELECT o_orderkey AS id, CAST(round(o_totalprice/10000) AS DOUBLE) AS score, CAST(o_orderstatus='F' AS INT) AS target FROM orders",
}
