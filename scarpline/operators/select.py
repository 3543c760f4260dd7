"""Exact selection of the k lowest rows, globally or by group, exact quantiles and sums below a score, without sorting all rows in one task.

A sketch of the leading column tells between which two values the k-th row lies; rows below are taken by a filter, and only those
between are ranked. If these are many (a score that a large part of the table shares), they are dealt into ranges of score and
key first, and only the range at the border is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.functions.scalars import HASH_BITS
from scarpline.sources.tables import saved

ROOT = 32
BUCKETS = ROOT * ROOT
#: One more than the largest portable hash.
HASH_RANGE = 1 << HASH_BITS
#: Rows that one task ranks at most.
RANKED = 1_000_000
#: The size of a KLL sketch (some 100 kB) and how many BUCKETS-ths a wanted rank is looked for on both sides; it is off by less than one of them.
SKETCH, MARGIN = 4096, 2


def bucket_edges(value: Column) -> Column:
    """An aggregate: the approximate quantiles that part BUCKETS buckets."""
    return F.percentile_approx(value, F.lit([i / BUCKETS for i in range(1, BUCKETS)]), 4 * BUCKETS)


def bucket_of(value: Column, edges: Column) -> Column:
    """How many edges are below the value; equal values share a bucket. Looks at every ROOT-th edge, then at those between two."""

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda e: e < value))

    coarse = below(F.transform(F.sequence(F.lit(1), F.lit(ROOT - 1)), lambda i: F.get(edges, i * ROOT - 1)))
    # An array of one gives the coarse number a name, so that it is computed once.
    found = F.transform(F.array(coarse), lambda c: c * ROOT + below(F.slice(edges, c * ROOT + 1, F.lit(ROOT - 1))))[0]
    return F.when(value.isNotNull() & edges.isNotNull(), found)


def sketch(value: Column) -> Column:
    """An aggregate: a mergeable sketch of the values, without nulls and NaN."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(SKETCH))


def sketched_quantiles(sketched: Column, at: Sequence[float]) -> Column:
    """The values near ranks from 0 to 1, an array; null for a sketch of nothing."""
    found = F.kll_sketch_get_quantile_double(sketched, F.lit([float(a) for a in at]).cast("array<double>"))
    return F.when(F.kll_sketch_get_n_double(sketched) > 0, found)


def _edges(sketched: Column) -> Column:
    return sketched_quantiles(sketched, [i / BUCKETS for i in range(1, BUCKETS)])


def threshold_select(df: DataFrame, k: DataFrame, lead: Column, ties: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The k lowest rows by (lead, ties) of each group.

    k: a table with the columns ``by`` and ``k``, one row for each group (one row in all without ``by``). Rows without a
    leading value (null or NaN) come last. With less than k rows, all are taken. Two passes find the values between which the
    k-th row lies and count what is below them, exactly.
    """
    rows = df.withColumn("_lead", F.nanvl(lead.cast("double"), F.lit(None).cast("double")))
    value = F.col("_lead")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), list(by)) if by else left.crossJoin(F.broadcast(right))

    sketches = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count("_lead").alias("_m"), sketch(value).alias("_s"))
    place = F.floor(F.col("k") * BUCKETS / F.col("_m")).cast("int")
    ends = joined(sketches, k).withColumns({"_edges": _edges(F.col("_s")), "_at": F.when(F.col("k") < F.col("_m"), place)})
    ends = saved(ends.select(*by, F.col("k").alias("_k"), "_n", "_m", F.get("_edges", F.col("_at") - 1 - MARGIN).alias("_low"), F.get("_edges", F.col("_at") - 1 + MARGIN).alias("_high")))
    # Rows below the lower end, and up to the upper one; an end that is beyond the edges is not there.
    below, upto = F.count_if(value < F.col("_low")), F.count_if(value <= F.coalesce("_high", F.lit(float("inf"))))
    counts = joined(rows, ends).groupBy(*by, "_k", "_n", "_m", "_low", "_high").agg(below.alias("_below"), upto.alias("_upto"))
    right = (F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_upto"))  # else the sketch was off by more than it ought to be
    inner = F.col("_k") < F.col("_m")
    found = counts.withColumns({"_low": F.when(right, F.col("_low")), "_high": F.when(right, F.col("_high")), "_below": F.when(right, F.col("_below")).otherwise(0), "_upto": F.when(right, F.col("_upto")).otherwise(F.col("_m"))})
    size = F.when(inner, F.col("_upto") - F.col("_below")).when(F.col("_k") < F.col("_n"), F.col("_n") - F.col("_m")).otherwise(0)
    plan = saved(found.select(*by, "_k", "_n", "_m", "_low", "_high", F.when(inner, F.col("_k") - F.col("_below")).otherwise(F.col("_k") - F.col("_m")).alias("_room"), size.alias("_size")))
    largest = plan.agg(F.max("_size").alias("size")).first()["size"] or 0
    marked, past = joined(rows, plan), F.col("_k") >= F.col("_n")
    whole = F.when(value.isNull(), past).when(inner, F.coalesce(value < F.col("_low"), F.lit(False))).otherwise(True)
    between = F.coalesce(value >= F.col("_low"), F.lit(True)) & F.coalesce(value <= F.col("_high"), F.lit(True))
    border = marked.where(F.when(inner, value.isNotNull() & between).otherwise(value.isNull() & ~past) & (F.col("_room") > 0))
    kept = _ranked(border, [*by], ["_lead", *ties], largest)
    return marked.where(whole).select(*df.columns).unionByName(kept.select(*df.columns))


def _ranked(border: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """The first ``_room`` rows of each group. Groups of more than RANKED rows are dealt into ranges of the order, and only a range is ranked by a task."""
    if size <= RANKED:
        return border.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank <= _room")
    dealt = saved(border.repartitionByRange(size * 4 // RANKED + 1, *by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    placed = dealt.join(F.broadcast(parts), [*by, "_part"]).where("_before < _room")
    return placed.withColumn("_rank", rank).where("_rank <= _room")


def numbered(df: DataFrame, lead: Column, ties: Sequence[str], by: Sequence[str] = (), name: str = "number") -> DataFrame:
    """Gapless numbers from 0 by (lead, ties) within each group; lead is from 0 to HASH_RANGE."""
    rows = df.withColumn("_bucket", F.floor(lead / (HASH_RANGE // BUCKETS + 1)).cast("int")).withColumn("_lead", lead)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "_bucket").count().select(*by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_lead", *ties)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(offsets), [*by, "_bucket"]).withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).select(*df.columns, name)


def one_row(df: DataFrame, k: Column | int) -> DataFrame:
    """A table of one row for ``threshold_select``: k from an aggregate over df."""
    return df.agg((F.lit(k) if isinstance(k, int) else k).cast("long").alias("k"))


def kept_count(n: Column, fraction: float) -> Column:
    """How many of n rows a fraction keeps: halves to even, one at least."""
    return F.greatest(F.bround(n * F.lit(float(fraction)), 0).cast("long"), F.lit(1))


def bottom_fraction(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The rows of the lowest scores, as many as the fraction keeps."""
    return threshold_select(df, one_row(df, kept_count(F.count("*"), fraction)), F.col(score), [key])


def score_ranges(df: DataFrame, score: str, **sums: Column) -> DataFrame:
    """score, the given aggregates for each distinct score, and each of them summed over all lower scores as ``<name>_below``.

    Distinct scores are counted once and kept. If there are more than a task can rank, they are cut into ranges by approximate
    quantiles and summed up within ranges; ranges are summed up apart.
    """
    counts = saved(df.groupBy(F.col(score).alias("score")).agg(*(c.alias(n) for n, c in sums.items())))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    if counts.count() <= RANKED:
        order = before(Window.partitionBy(F.lit(0)).orderBy("score"))
        return counts.select("score", *sums, *(summed(n, order).alias(f"{n}_below") for n in sums))
    ranged = counts.crossJoin(F.broadcast(counts.agg(bucket_edges(F.col("score")).alias("_edges")))).withColumn("_range", bucket_of(F.col("score"), F.col("_edges"))).drop("_edges")
    order, inner = before(Window.partitionBy(F.lit(0)).orderBy("_range")), before(Window.partitionBy("_range").orderBy("score"))
    whole = ranged.groupBy("_range").agg(*(F.sum(n).alias(n) for n in sums)).select("_range", *(summed(n, order).alias(f"_{n}") for n in sums))  # BUCKETS rows at most
    rows = ranged.select("*", *(summed(n, inner).alias(f"_in_{n}") for n in sums)).join(F.broadcast(whole.withColumnRenamed("_range", "_of")), F.col("_range").eqNullSafe(F.col("_of")))
    return rows.select("score", *sums, *((F.col(f"_{n}") + F.col(f"_in_{n}")).alias(f"{n}_below") for n in sums))


def _segment(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value."""
    return F.size(F.filter(F.lit(list(cuts)).cast("array<double>"), lambda c: c < value))


def ranked_values(df: DataFrame, score: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, float]]:
    """How many values there are, and those at the given ranks from 0 (a function of the count) in ascending order; nulls and NaN don't count.

    A sketch cuts the values around each rank; segments are counted, and cut again while one that holds a rank has more than
    RANKED rows of more than one value. Then the values of these segments are counted, a segment by a task.
    """
    value = F.col(score).cast("double")
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    first = rows.agg(F.count("*").alias("n"), _edges(sketch(F.col("v"))).alias("edges")).first()
    n, wanted = first["n"], sorted(set(ranks(first["n"]))) if first["n"] else []
    if not wanted:
        return n, {}

    def around(edges: Sequence[float], place: float) -> list[float]:
        at = int(place * BUCKETS) - 1
        return [edges[i] for i in (at - MARGIN, at + MARGIN) if 0 <= i < len(edges)]

    cuts = sorted({c for r in wanted for c in around(first["edges"], r / n)}) if n > RANKED else []
    while True:
        counted = rows.groupBy(_segment(F.col("v"), cuts).alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), _edges(sketch(F.col("v"))).alias("edges")) if cuts else None
        segments = sorted(counted.collect(), key=lambda r: r["s"]) if counted else [{"s": 0, "n": n, "low": 0.0, "high": 0.0, "edges": []}]
        of, start = {}, {}
        at = 0
        for g in segments:  # two for each rank, and one more
            start[g["s"]] = at
            of.update({r: g for r in wanted if at <= r < at + g["n"]})
            at += g["n"]
        more = {c for r, g in of.items() if g["n"] > RANKED and g["low"] < g["high"] for c in around(g["edges"], (r - start[g["s"]]) / g["n"])} - set(cuts)
        if not more:
            break
        cuts = sorted({*cuts, *more})
    needed = sorted({g["s"] for g in of.values()})
    counts = rows.withColumn("s", _segment(F.col("v"), cuts)).where(F.col("s").isin(needed)).groupBy("s", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begin = F.create_map(*(F.lit(x) for s in needed for x in (s, start[s])))
    placed = counts.withColumn("_end", F.element_at(begin, F.col("s")) + upto)
    hit = F.exists(F.lit(wanted).cast("array<bigint>"), lambda r: (r >= F.col("_end") - F.col("n")) & (r < F.col("_end")))
    found = placed.where(hit).collect()  # as many rows as ranks at most
    return n, {r: g["v"] for r in wanted for g in found if g["_end"] - g["n"] <= r < g["_end"]}


def exact_quantiles(df: DataFrame, score: str, at: Sequence[float]) -> DataFrame:
    """One row, ``quantiles``: exact ones with linear interpolation, null without scores."""
    places = lambda n: [(n - 1) * float(q) for q in at]
    n, values = ranked_values(df, score, lambda n: [f(p) for p in places(n) for f in (math.floor, math.ceil)])

    def between(place: float) -> float:
        low, high, part = values[math.floor(place)], values[math.ceil(place)], place - math.floor(place)
        return low if low == high else (1 - part) * low + part * high

    return df.sparkSession.createDataFrame([([between(p) for p in places(n)] if n else None,)], "quantiles array<double>")
