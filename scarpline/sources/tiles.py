"""A store of pixels by layer and tile, of which a scan reads only the tiles that it needs.

Tiles are squares of pixels, numbered along a Morton curve, so that near tiles have near numbers; layer and tile are partitions of the
table, and a tile's pixels are sorted by row and column. The lattices of wanted strides are kept as small copies beside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions.scalars import on_lattice

#: Tiles that a filter names one by one, and points that are sent to the pixels; more are joined by shuffle.
NAMED, SENT = 5000, 1_000_000
_BITS = 15


def morton(row: Column, col: Column) -> Column:
    """The place on the Morton curve of a row and a column below 2^15: their bits by turns."""
    bit = lambda c, i: F.shiftleft(F.shiftright(c, i).bitwiseAND(1), 2 * i)
    return reduce(lambda a, b: a + b, [bit(col, i) + F.shiftleft(bit(row, i), 1) for i in range(_BITS)])


@dataclass(frozen=True)
class Tiles:
    """A store at ``path``, with tiles of ``2^shift`` by ``2^shift`` pixels."""

    spark: SparkSession
    path: str
    shift: int = 8

    def tile(self) -> Column:
        return morton(F.shiftright("row", self.shift), F.shiftright("col", self.shift)).cast("int")

    def pixels(self) -> DataFrame:
        return self.spark.read.schema("row int, col int, value double, layer string, tile int").parquet(f"{self.path}/pixels")

    def lattice(self, layer: str, stride: int) -> DataFrame:
        """layer, row, col, value of a layer's pixels on a lattice: the copy of the largest stride that divides this one, else all pixels."""
        kept = [s for s in self.strides() if stride % s == 0]
        rows = self.spark.read.schema("row int, col int, value double, layer string").parquet(f"{self.path}/lattice{max(kept)}") if kept else self.pixels()
        return rows.where((F.col("layer") == layer) & on_lattice(F.col("row"), F.col("col"), stride)).select("layer", "row", "col", "value")

    def strides(self) -> list[int]:
        return [r["stride"] for r in self.spark.read.parquet(f"{self.path}/strides").collect()]  # some numbers

    def joined(self, placed: DataFrame) -> DataFrame:
        """Rows with layer, row and col, and the ``value`` of their pixel, null where there is none.

        The tiles of the rows become a filter on partitions. Up to SENT different pixels are sent to the scan, so nothing of the store
        is shuffled; for more, what is left of it is joined by shuffle.
        """
        wanted = placed.where("row >= 0 and col >= 0").select("layer", "row", "col").distinct().withColumn("tile", self.tile())
        places = wanted.groupBy("layer").agg(F.collect_set("tile").alias("tiles"), F.count("*").alias("n")).collect() if wanted.select("layer", "tile").distinct().limit(NAMED + 1).count() <= NAMED else None
        rows = self.pixels()
        if places is not None:
            named = [(F.col("layer") == p["layer"]) & F.col("tile").isin(sorted(p["tiles"])) for p in places]
            rows = rows.where(reduce(or_, named)) if named else rows.limit(0)
            if sum(p["n"] for p in places) <= SENT:
                rows = rows.join(F.broadcast(wanted), ["layer", "tile", "row", "col"], "left_semi")
        return placed.join(rows.select("layer", "row", "col", "value"), ["layer", "row", "col"], "left")


def write_tiles(pixels: DataFrame, path: str, shift: int = 8, strides: Sequence[int] = ()) -> Tiles:
    """Write pixels (layer, row, col, value) as a store, with copies for lattices of the given strides. A tile is written by one task."""
    spark = pixels.sparkSession
    store = Tiles(spark, path, shift)
    rows = pixels.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), "layer").withColumn("tile", store.tile())
    rows.repartition("layer", "tile").sortWithinPartitions("layer", "tile", "row", "col").write.mode("overwrite").partitionBy("layer", "tile").parquet(f"{path}/pixels")
    for s in strides:
        store.pixels().where(on_lattice(F.col("row"), F.col("col"), s)).drop("tile").write.mode("overwrite").partitionBy("layer").parquet(f"{path}/lattice{s}")
    spark.createDataFrame([(s,) for s in strides], "stride int").write.mode("overwrite").parquet(f"{path}/strides")
    return store
