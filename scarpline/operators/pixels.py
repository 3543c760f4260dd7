"""Class layers as tables of pixels (layer, row, col, value) or as a store of tiles, and their small metadata table: layer, x0, y0, px, py, nodata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.functions.scalars import centre_of, missing, on_lattice, pixel_of
from scarpline.operators.fr import fr_lookup
from scarpline.sources.tiles import Tiles


def valid_pixels(pixels: DataFrame | Tiles, meta: DataFrame, layer: str, stride: int) -> DataFrame:
    """row, col, x, y of a layer's pixels on the lattice whose value is above 0, finite and not nodata (null: the layer has none). Filters reach the scan."""
    found = pixels.lattice(layer, stride) if isinstance(pixels, Tiles) else pixels.where((F.col("layer") == layer) & on_lattice(F.col("row"), F.col("col"), stride))
    rows = found.where("value > 0")
    rows = rows.join(F.broadcast(meta), "layer").where((F.col("nodata").isNull() | (F.col("value") != F.col("nodata"))) & missing("value").isNotNull())
    x, y = centre_of(*(F.col(c) for c in ("row", "col", "x0", "y0", "px", "py")))
    return rows.select("row", "col", x.alias("x"), y.alias("y"))


def sample_layers(points: DataFrame, key: str, pixels: DataFrame | Tiles, meta: DataFrame, layers: Sequence[str] | None = None) -> DataFrame:
    """key, layer, value for each point and layer: one join for all layers; outside, nodata and NaN give null."""
    meta = meta if layers is None else meta.where(F.col("layer").isin(*layers))
    spread = points.select(key, "x", "y").crossJoin(F.broadcast(meta))  # as many rows for a point as there are layers
    row, col = pixel_of(*(F.col(c) for c in ("x", "y", "x0", "y0", "px", "py")))
    placed = spread.select(key, "layer", "nodata", row.alias("row"), col.alias("col"))
    if isinstance(pixels, Tiles):
        valued = pixels.joined(placed)
    else:
        valued = placed.join(pixels if layers is None else pixels.where(F.col("layer").isin(*layers)), ["layer", "row", "col"], "left")
    return valued.select(key, "layer", missing("value", F.col("nodata")).alias("value"))


def sample_stack(points: DataFrame, key: str, pixels: DataFrame | Tiles, meta: DataFrame, registry: DataFrame, fr: DataFrame, features: Sequence[str]) -> DataFrame:
    """key, x, y and one FR column for each feature. registry: column, factor, layer."""
    active = registry.where(F.col("column").isin(*features))
    layers = [r["layer"] for r in active.select("layer").distinct().collect()]  # the registry, some dozen rows
    values = sample_layers(points, key, pixels, meta, layers).join(F.broadcast(active), "layer")
    weighted = fr_lookup(values, fr)
    wide = weighted.groupBy(key).pivot("column", list(features)).agg(F.first("FR"))
    return points.select(key, "x", "y").join(wide, key).select(key, "x", "y", *features)


def pixel_key() -> Column:
    """One number for row and col, different for all pixels of a layer."""
    return F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")


def grid_rows(pixels: DataFrame | Tiles, registry: DataFrame, fr: DataFrame, features: Sequence[str], meta: DataFrame, stride: int, pool_layer: str) -> DataFrame:
    """x, y and the features at the centres of the pool layer's valid lattice pixels; every layer is sampled by its own transform."""
    centres = valid_pixels(pixels, meta, pool_layer, stride).select(pixel_key().alias("pixel"), "x", "y")
    return sample_stack(centres, "pixel", pixels, meta, registry, fr, features).drop("pixel")
