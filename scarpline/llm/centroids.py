"""Exact Lloyd clustering of integer vectors with heaps of bounds.

A vector that is u from its centroid and l from the next nearest can't change its cluster before the centroids have moved by l - u. So a
cluster keeps its vectors in a heap by that gap. Gaps aren't lowered when centroids move; instead the cluster's offset rises by its own
drift and the largest drift of the others, and a vector goes into the heap with its gap plus the offset of that time. Those whose key the
offset has reached are popped and measured against all centroids, in exact integers, and go into the heap of their cluster with a new key;
all others stay untouched and unread.

A heap is kept as sorted runs: each round writes those that it has popped as one more run, in the order of cluster and key. As offsets only rise,
a row of any run is in the heap if its key is above the offset at the last round, and is popped now if the offset has passed it since. Both
are ranges of keys, which the scan of the runs gets as filters, so nothing is deleted or rewritten and runs need no join. Sums of clusters are
kept up to date by what has moved between them; vectors are never shuffled.

A run is a table in the shared folder: lost executors cost their tasks alone. The driver holds centroids, offsets, and sums of clusters.

Rows whose vector is null, holds null, NaN or an infinity, has another length than ``dims``, or has an entry beyond ``LIMIT`` (where squares
would leave 64 bits) are left out. Rows are never told apart by id, so repeated and null ids are fine; a null id starts as the text "null".
Equal distances go to the smaller number; of equal first centroids the later ones stay empty. With fewer rows than ``k`` there are as many
centroids as rows. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch

#: Integers of entries are below this: a squared distance of up to 128 dimensions fits into 64 bits.
LIMIT = 1 << 26
#: More than what roots and sums of drifts are off by; a gap expires that much earlier.
SLACK = 1e-3


@dataclass(frozen=True)
class Clustering:
    """rows: id, cluster, distance (squared, exact). Of each cluster: centroid, rows and inertia. popped: how many rows each round measured."""

    rows: DataFrame
    centroids: list[list[int]]
    sizes: list[int]
    inertia: list[int]
    popped: list[int]

    def digests(self) -> list[str]:
        """The SHA-256 of each centroid's components as decimal numbers with commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centroids, in integers."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def vectors(df: DataFrame, id: str, vector: str, dims: int, scale: float = 1024.0) -> DataFrame:
    """id and x, the integers ``floor(scale * component)`` of usable rows."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * scale >= float(LIMIT)))
    rows = df.where(v.isNotNull() & (F.size(v) == dims) & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of the smallest hash of their id, in its order."""
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return [list(r["x"]) for r in rows.select(draw.alias("draw"), "x").orderBy("draw", "x").limit(k).collect()]


def _measured(rows: DataFrame, centroids: Sequence[Sequence[int]], bounds: Sequence[float]) -> DataFrame:
    """id, x, cluster, was and key: rows (id, x, cluster) measured against all centroids, as they go into the heaps."""
    at, floor_, dims = np.array(centroids, np.int64), np.array(bounds), len(centroids[0])
    least = np.nextafter(floor_, np.inf)  # above the bound, so that the next movement finds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _squared(_integers(b.column(1), dims), at)
            own = d.argmin(axis=1)  # the first of equal ones
            near = d[np.arange(len(d)), own]
            d[np.arange(len(d)), own] = np.iinfo(np.int64).max
            gap = np.sqrt(d.min(axis=1)) - np.sqrt(near) if len(at) > 1 else np.full(len(d), np.inf)
            key = np.maximum(gap - SLACK + floor_[own], least[own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), b.column(2), pa.array(key)], ["id", "x", "cluster", "was", "key"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<int>, cluster int, was int, key double")


def _between(low: Sequence[float], high: Sequence[float] | None = None) -> Column:
    """Rows of the heaps above the bounds ``low``, and up to ``high`` if that is given."""
    parts = [(F.col("cluster") == c) & (F.col("key") > low[c]) & (F.lit(True) if high is None else F.col("key") <= high[c]) for c in range(len(low)) if high is None or high[c] > low[c]]
    return reduce(or_, parts)


def _changes(run: DataFrame, k: int, dims: int) -> np.ndarray:
    """Rows and component sums that each cluster gained (or lost, below 0) by the rows that moved: k times (1 + dims) numbers.

    Each task sums its rows; Spark sums the tasks' numbers.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + dims), np.int64)
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows, np.int64), _integers(b.column(0), dims)])
            now, was = b.column(1).to_numpy(), b.column(2).to_numpy()
            for c in range(k):
                total[c] += x[now == c].sum(axis=0) - x[was == c].sum(axis=0)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], ["total"])

    moved = run.where("cluster <> was").select("x", "cluster", "was").mapInArrow(sums, "total array<long>")
    out = np.zeros(k * (1 + dims), object)
    for r in moved.select(F.posexplode("total").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(k, 1 + dims)


def cluster(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3", scale: float = 1024.0) -> Clustering:
    """Rounds of assignment and ``floor(sum / count)`` of each cluster, then a last assignment; an empty cluster's centroid stays."""
    rows = vectors(df, id, vector, dims, scale)
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        none = rows.select(F.col("id").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return Clustering(none, [], [], [], [])
    spark, folder, k = df.sparkSession, scratch(df.sparkSession, "heaps"), len(centroids)
    bounds, totals, popped = [0.0] * k, np.zeros((k, 1 + dims), object), []
    out, paths = rows.select("id", "x", F.lit(-1).alias("cluster")), []
    for t in range(rounds + 1):
        paths.append(f"{folder}/run{t}")
        _measured(out, centroids, bounds).sortWithinPartitions("cluster", "key").write.parquet(paths[-1])
        run = spark.read.parquet(paths[-1])
        popped.append(run.count())
        if t == rounds:
            break
        totals = totals + _changes(run, k, dims)
        moved = [[int(s) // int(row[0]) for s in row[1:]] if row[0] else centroids[c] for c, row in enumerate(totals)]
        drift = [math.dist(a, b) for a, b in zip(centroids, moved, strict=True)]
        centroids, before = moved, bounds
        bounds = [b + drift[c] + max((drift[j] for j in range(k) if j != c), default=0.0) for c, b in enumerate(bounds)]
        if bounds == before:  # no centroid has moved, nor will one
            break
        out = spark.read.parquet(*paths).where(_between(before, bounds)).select("id", "x", "cluster")
    live = spark.read.parquet(*paths).where(_between(bounds))
    at = np.array(centroids, np.int64)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(2).to_numpy()
                d = ((_integers(b.column(1), dims) - at[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d)], ["id", "cluster", "distance"])

    found = live.select("id", "x", "cluster").mapInArrow(last, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")
    found = saved(found, "clusters")
    ends = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}
    sizes, inertia = ([ends[c][name] if c in ends else 0 for c in range(k)] for name in ("n", "inertia"))
    return Clustering(found.withColumnRenamed("id", id), centroids, sizes, inertia, popped)
