"""Whitening of embeddings by an eigendecomposition that grows row by row.

Each task keeps the count, mean and spectrum of its rows, and adds each row as a centred rank-one update (``spectrum``). Tasks' spectra are
combined by rank-one updates too, FAN at a time, until one is left; it is a basis near the eigenvectors. The last step is exact: all rows,
centred, are projected on that basis, the products are summed over tasks in the same tree, and the small matrix that they give turns the
basis (Rayleigh-Ritz). As the basis is whole, what comes out are the covariance's own eigenpairs, to double precision.

Entries become integers ``floor(scale * c) + shift``, so counts and sums are exact, and a centred row is ``(n * x - S) / n`` with one rounding.

Rows whose vector is null, holds null, NaN or an infinity are left out; so are rows of another length than ``dims`` (the most frequent one,
if not given; of equally frequent ones the shorter) and those with an entry whose integer is beyond ``LIMIT``, where sums would not be exact.
Repeated rows count as often as they come. Components whose eigenvalue is nothing but rounding (constant columns, fewer rows than
dimensions) are left out, as they can't be scaled. Without usable rows the result is empty. Input columns that clash are replaced.

What reaches a task or the driver at once is FAN spectra of ``dims * dims`` numbers, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from .common import saved
from .spectrum import EPS, Spectrum

FAN = 16
#: Integers of entries are below this, so sums of 10^11 rows are exact.
LIMIT = 1 << 26
_PART = "part int, data binary"


def usable(vector: Column, dims: int | None = None, scale: float = 1024.0) -> Column:
    """Whether a vector has only finite entries within the limit, and ``dims`` of them."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale >= float(LIMIT)))
    found = vector.isNotNull() & ~F.coalesce(bad, F.lit(True))
    return found if dims is None else found & (F.size(vector) == dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """n rows, the sums of their integers, components (rows, by falling eigenvalue), their eigenvalues, the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    scale: float
    shift: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def away(self, column: pa.Array) -> np.ndarray:
        """n * x - S, in integers."""
        return self.n * (np.floor(self.scale * matrix(column, self.dims)).astype(np.int64) + self.shift) - self.sums

    def whitened(self, away: np.ndarray) -> np.ndarray:
        return (away / self.n) @ self.components.T / np.sqrt(self.values)


def _gathered(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from those of all tasks, FAN of them at a time."""
    parts = saved(parts, "parts")
    top = parts.agg(F.max("part").alias("top")).first()["top"]

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "data": [combine(list(rows["data"]))]})

    while top:
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(step, _PART)
        top //= FAN
    return None if top is None else bytes(parts.first()["data"])


def _by_task(df: DataFrame, vector: str, work: Callable[[Iterator[pa.Array]], bytes | None]) -> DataFrame:
    """part and data: what ``work`` makes of each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[int] = []

        def columns() -> Iterator[pa.Array]:
            for b in batches:
                if b.num_rows:
                    part[:] = [b.column(0)[0].as_py()]
                    yield b.column(1)

        data = work(columns())
        if part and data is not None:
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    return df.select(F.spark_partition_id().alias("part"), vector).mapInArrow(run, _PART)


def _spectra(dims: int, scale: float) -> tuple[Callable[[Iterator[pa.Array]], bytes], Callable[[list[bytes]], bytes]]:
    """The work of a task and of a merge: exact sums (integers) before the packed spectrum."""

    def work(columns: Iterator[pa.Array]) -> bytes:
        found, sums = Spectrum.empty(dims), np.zeros(dims, np.int64)
        for column in columns:
            x = np.floor(scale * matrix(column, dims))
            sums += x.astype(np.int64).sum(axis=0)
            for row in x:
                found.add(row)
        return sums.tobytes() + found.packed()

    def combine(parts: list[bytes]) -> bytes:
        sums, found = np.zeros(dims, np.int64), Spectrum.empty(dims)
        for p in parts:
            sums += np.frombuffer(p, "<i8", dims)
            found.merge(Spectrum.unpacked(p[8 * dims :], dims))
        return sums.tobytes() + found.packed()

    return work, combine


def _summed(parts: list[bytes]) -> bytes:
    return sum(np.frombuffer(p, "<f8") for p in parts).tobytes()


def length_of(df: DataFrame, vector: str = "embedding") -> int | None:
    """The most frequent number of entries of usable vectors; None without any."""
    row = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    return row["d"] if row else None


def fit(df: DataFrame, *, vector: str = "embedding", components: int = 8, dims: int | None = None, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all usable rows; None if there are none."""
    dims = length_of(df, vector) if dims is None else dims
    if not dims:
        return None
    rows = df.where(usable(F.col(vector), dims, scale))
    grown = _gathered(_by_task(rows, vector, (work := _spectra(dims, scale))[0]), work[1])
    if grown is None:
        return None
    rough = Spectrum.unpacked(grown[8 * dims :], dims)
    n, sums = rough.n, np.frombuffer(grown, "<i8", dims) + rough.n * shift
    basis, _ = np.linalg.qr(rough.vectors[:, ::-1])
    whole = Whitening(n, sums, basis.T, np.ones(dims), 0.0, scale, shift)

    def products(columns: Iterator[pa.Array]) -> bytes:
        total = np.zeros((dims, dims))
        for column in columns:
            y = (whole.away(column) / n) @ basis
            total += y.T @ y
        return total.tobytes()

    ritz = np.frombuffer(_gathered(_by_task(rows, vector, products), _summed), "<f8").reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(values.sum())
    some = int((values[:components] > dims * EPS * max(trace, 1e-300)).sum())
    axes = (basis @ turn[:, :some]).T
    axes *= np.sign(axes[np.arange(some), np.abs(axes).argmax(axis=1)])[:, None]  # the largest entry is above 0
    return Whitening(n, sums, axes, values[:some], trace, scale, shift)


def identity_error(df: DataFrame, found: Whitening, *, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(found.values)
    if not k:
        return 0.0

    def moments(columns: Iterator[pa.Array]) -> bytes:
        total, square = np.zeros(k), np.zeros((k, k))
        for column in columns:
            y = found.whitened(found.away(column))  # their mean is 0 but for rounding, which the sums take off
            total += y.sum(axis=0)
            square += y.T @ y
        return np.concatenate([total, square.ravel()]).tobytes()

    rows = df.where(usable(F.col(vector), found.dims, found.scale))
    all_ = np.frombuffer(_gathered(_by_task(rows, vector, moments), _summed), "<f8") / found.n
    covariance = all_[k:].reshape(k, k) - np.outer(all_[:k], all_[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def transform(df: DataFrame, found: Whitening | None, *, vector: str = "embedding") -> DataFrame:
    """Usable rows with ``deviation`` (the sum over dimensions of (n * x - S) squared, exact) and ``whitened`` (an array, one number a component)."""
    added = [StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))]
    kept = df.drop("deviation", "whitened")
    schema = StructType([*kept.schema.fields, *added])
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    at = kept.columns.index(vector)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            away = found.away(b.column(at))
            most = int(np.abs(away).max())
            squares = away * away if most * most * found.dims < 1 << 63 else away.astype(object) ** 2  # integers without bound
            deviation = pa.array([int(x) for x in squares.sum(axis=1)], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(0, k * b.num_rows + 1, k) if k else np.zeros(b.num_rows + 1), pa.int32())
            scores = pa.ListArray.from_arrays(offsets, pa.array(found.whitened(away).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, deviation, scores], [*b.schema.names, "deviation", "whitened"])

    return kept.where(usable(F.col(vector), found.dims, found.scale)).mapInArrow(run, schema)
