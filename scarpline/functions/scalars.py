"""Row-wise expressions: missing values, classes, pixels, projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(value: Column | str, nodata: Column | float | None = None, tolerance: float = 1e-3) -> Column:
    """NaN, infinities and values within ``tolerance`` of nodata become null, the one sign of a missing value."""
    v = _col(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if nodata is not None:
        bad = bad | F.coalesce(F.abs(v - nodata) < tolerance, F.lit(False))  # a layer may have no nodata value
    return F.when(~bad | v.isNull(), v)


def as_class(value: Column | str) -> Column:
    """The class number of a raster value: nearest integer, halves to even."""
    return F.rint(_col(value)).cast("int")


def reclass_breaks(value: Column | str, breaks: Sequence[float]) -> Column:
    """Class 1.. by ascending breaks; a value equal to a break opens the higher class."""
    v = _col(value)
    return F.when(v.isNotNull(), reduce(add, [(v >= b).cast("int") for b in breaks], F.lit(1)))


def reclass_edges(value: Column | str, edges: Column) -> Column:
    """Class 1.. by an array of inner edges; a value equal to an edge stays in the lower class."""
    v = _col(value)
    return F.when(v.isNotNull(), F.size(F.filter(edges, lambda e: e < v)) + 1)


def pixel_of(x: Column, y: Column, x0: Column, y0: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point; (x0, y0) is the upper left corner."""
    return F.floor((y0 - y) / py).cast("int"), F.floor((x - x0) / px).cast("int")


def centre_of(row: Column, col: Column, x0: Column, y0: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """The centre (x, y) of a pixel."""
    return x0 + (col + 0.5) * px, y0 - (row + 0.5) * py


def on_lattice(row: Column, col: Column, stride: int) -> Column:
    """Whether a pixel is on the lattice of every stride-th row and column."""
    return (F.pmod(row, F.lit(stride)) == 0) & (F.pmod(col, F.lit(stride)) == 0)


def index_sum(columns: Sequence[str]) -> Column:
    """The sum of factor weights of a row; null if one is missing."""
    return reduce(add, [F.col(c) for c in columns])


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The squared distance; compared with squared radii, it needs no root."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


HASH_BITS = 31


def _stirred(x: Column) -> Column:
    """A permutation of the numbers below 2^31: a shift, and the product with an odd number."""
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * 73244475, F.lit(1 << HASH_BITS))


def portable_hash(key: Column | str, seed: Column | int) -> Column:
    """A number below 2^31 that any SQL engine computes alike: key and seed are stirred before and after they meet, so that draws of two seeds are independent.

    All 64 bits of the key count; products stay below 2^63.
    """
    whole, k = F.lit(1 << HASH_BITS), _col(key).cast("long")
    low = F.pmod(F.pmod(k, whole) + F.pmod(F.shiftright(k, HASH_BITS), whole) * 1103515245 + F.shiftright(k, 2 * HASH_BITS) * 715225739, whole)
    salt = F.pmod(F.pmod(F.lit(seed).cast("long"), whole) * 1566083941, whole)
    return _stirred(_stirred(F.pmod(_stirred(low) + salt, whole)))


def uniform(key: Column | str, seed: int) -> Column:
    """A number between 0 and 1 from a hash of key and seed, the same wherever and whenever the row is looked at."""
    return (F.shiftrightunsigned(F.xxhash64(_col(key), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def z_score(value: Column | str, mean: Column, sd: Column) -> Column:
    """Standard score; a spread of 0 divides by 1."""
    return (_col(value) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


#: Fixed values of WGS84 and of its UTM grid: half axis, flattening, scale at the central meridian, false easting and northing.
AXIS, FLATTENING, UTM_SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series in the third flattening n: to the grid, from the grid, and from the conformal latitude.
_TO_GRID = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_FROM_GRID = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
_LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def _south(north: Column | bool) -> Column:
    return F.when(F.lit(north), F.lit(0.0)).otherwise(F.lit(SOUTH))


def _let(then: Callable[[Column], Column], **values: Column) -> Column:
    """``then`` of a struct of values: each is computed once, however often it is used."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), then), 0)


def utm(lon: Column | str, lat: Column | str, zone: Column | int, north: Column | bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres of WGS84 degrees, by Krueger's series of the transverse Mercator projection."""
    c, south = 2 * math.sqrt(_N) / (1 + _N), _south(north)

    def grid(v: Column) -> Column:
        east, up = v["eta"], v["xi"]
        for j, k in enumerate(_TO_GRID, 1):
            east = east + k * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            up = up + k * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return F.struct((EAST + UTM_SCALE * _RADIUS * east).alias("x"), (UTM_SCALE * _RADIUS * up).alias("y"))

    def plane(v: Column) -> Column:
        return _let(grid, xi=F.atan2(v["t"], F.cos(v["dl"])), eta=F.atanh(F.sin(v["dl"]) / F.sqrt(1 + v["t"] * v["t"])))

    def sphere(v: Column) -> Column:
        return _let(plane, t=F.sinh(F.atanh(v["s"]) - c * F.atanh(c * v["s"])), dl=v["dl"])

    found = _let(sphere, s=F.sin(F.radians(_col(lat))), dl=F.radians(_col(lon) - (F.lit(zone) * 6.0 - 183.0)))
    return found["x"], south + found["y"]


def degrees(x: Column | str, y: Column | str, zone: Column | int, north: Column | bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing in a UTM zone, by the inverse series."""

    def plane(v: Column) -> Column:
        up, east = v["xi"], v["eta"]
        for j, k in enumerate(_FROM_GRID, 1):
            up = up - k * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            east = east - k * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return _let(sphere, up=up, east=east)

    def sphere(v: Column) -> Column:
        return _let(ellipsoid, chi=F.asin(F.sin(v["up"]) / F.cosh(v["east"])), dl=F.atan2(F.sinh(v["east"]), F.cos(v["up"])))

    def ellipsoid(v: Column) -> Column:
        phi = v["chi"]
        for j, k in enumerate(_LATITUDE, 1):
            phi = phi + k * F.sin(2 * j * v["chi"])
        return F.struct(F.degrees(v["dl"]).alias("x"), F.degrees(phi).alias("y"))

    scale = UTM_SCALE * _RADIUS
    found = _let(plane, xi=(_col(y) - _south(north)) / scale, eta=(_col(x) - EAST) / scale)
    return F.lit(zone) * 6.0 - 183.0 + found["x"], found["y"]


def known_system(code: Column | str) -> Column:
    """Whether a code names WGS84 degrees or a UTM zone of it, north or south."""
    return F.coalesce(F.upper(F.trim(_col(code))).rlike(r"^EPSG:(4326|32[67](0[1-9]|[1-5][0-9]|60))$"), F.lit(False))


def reprojected(x: Column | str, y: Column | str, code: Column | str, target: str) -> tuple[Column, Column]:
    """x and y in the system ``target``, from that which each row's code names (EPSG:4326, 326zz, 327zz); null for others.

    Rows that are in the target system already stay as they are.
    """
    there, goal = F.upper(F.trim(_col(code))), target.strip().upper()
    zone, north = F.substring(there, -2, 2).try_cast("int"), F.substring(there, 1, 8) == "EPSG:326"
    lon, lat = degrees(x, y, zone, north)
    plain = there == "EPSG:4326"
    lon, lat = F.when(plain, _col(x)).otherwise(lon), F.when(plain, _col(y)).otherwise(lat)
    to = (lon, lat) if goal == "EPSG:4326" else utm(lon, lat, int(goal[-2:]), goal[5:8] == "326")
    return tuple(F.when(there == goal, a).when(known_system(code), b) for a, b in zip((_col(x), _col(y)), to, strict=True))
