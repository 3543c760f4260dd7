"""Joins by distance. A radius becomes a grid: one side is copied to the 3 x 3 cells around it, cells join by equality, and
the exact distance is tested after that. A crowded cell is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.functions.scalars import distance2
from scarpline.sources.tables import saved


def cells(df: DataFrame, r: float, spread: bool) -> DataFrame:
    """Add cell numbers _cx, _cy; with spread, those around too, each a row."""
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    cell = {"_cx": F.floor(F.col("x") / r), "_cy": F.floor(F.col("y") / r)}
    if not spread:
        return df.withColumns(cell)
    return df.withColumns(cell).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}).drop("_dx", "_dy")


def _near(r: float, strict: bool) -> Column:
    d2 = distance2(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    return d2 < r * r if strict else d2 <= r * r


def distance_join(left: DataFrame, right: DataFrame, r: float, how: str = "inner", strict: bool = False) -> DataFrame:
    """Join tables with x and y by distance at most r (below r if strict); how: inner, left_semi or left_anti.

    An inner join has the left columns, and the right ones as ``right_<name>``. The right side is the one that is copied.
    """
    a, b = cells(left, r, False).alias("l"), cells(right, r, True).alias("r")
    on = (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy")) & _near(r, strict)
    joined = a.join(b, on, how)
    if how == "inner":
        return joined.select(*(F.col(f"l.{c}") for c in left.columns), *(F.col(f"r.{c}").alias(f"right_{c}") for c in right.columns))
    return joined.select(*(F.col(f"l.{c}") for c in left.columns))


def away_from(candidates: DataFrame, points: DataFrame, buffer: float) -> DataFrame:
    """Candidates at least ``buffer`` from every point; a distance equal to the buffer is far enough."""
    return distance_join(candidates, points.select("x", "y").distinct(), buffer, "left_anti", strict=True)


def ring(candidates: DataFrame, points: DataFrame, inner: float, outer: float | None = None) -> DataFrame:
    """Candidates whose nearest point is from ``inner`` to ``outer`` away, both included."""
    far = away_from(candidates, points, inner)
    return far if outer is None else distance_join(far, points.select("x", "y").distinct(), outer, "left_semi")


def buffer_control(df: DataFrame, inner: float = 500.0, outer: float | None = None, some: bool = True) -> DataFrame:
    """All positives, and the negatives in the ring around them. Without negatives the table stays as it is; if none is left, an error says so, or, unless ``some``, only positives come back."""
    positive, negative = df.where("target = 1"), df.where("target = 0")
    if negative.isEmpty():
        return df
    kept = ring(negative, positive, inner, outer)
    if some and kept.isEmpty():
        raise ValueError("No negatives are left in the buffer ring")
    return positive.unionByName(kept)


#: Cells halve BITS times at most; a step of the descent takes STEP halvings at once.
BITS, STEP = 24, 2
#: Tables of cells up to this many rows are broadcast.
SMALL = 100_000


def has_place() -> Column:
    """Whether a row has both coordinates, neither null nor NaN nor infinite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite("x") & finite("y")


def placed(df: DataFrame) -> DataFrame:
    return df.where(has_place())


def _boxes(*more: Column) -> tuple[Column, ...]:
    """Aggregates: the tight box of points, and others."""
    return *more, *(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max)))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def _tree(points: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame, Callable[[int], Column]]:
    """Cells of each level of a tree over distinct points, the points with their last cell (bits, cell), and the cell of x and y by bits.

    A level has parent, cell, the tight box, and whether the cell is ``last``: only cells of more than ``leaf`` points are cut, into
    4^STEP, so a crowded place has deep cells and an empty one none.
    """
    side = points.agg(*_boxes()).first()
    wide = max(side["high_x"] - side["low_x"], side["high_y"] - side["low_y"]) or 1.0
    at = lambda c: F.greatest(F.least(F.floor((F.col(c) - side[f"low_{c}"]) / wide * (1 << BITS)), F.lit((1 << BITS) - 1)), F.lit(0))
    cell = lambda bits: F.shiftleft(F.shiftright(at("x"), BITS - bits), BITS) + F.shiftright(at("y"), BITS - bits)
    rest, levels, done, bits = points, [], None, 0
    while True:
        bits += STEP
        last = (F.col("_n") <= leaf) | F.lit(bits >= BITS)
        rest = rest.withColumns({"parent": cell(bits - STEP), "cell": cell(bits)})
        levels.append(saved(rest.groupBy("parent", "cell").agg(*_boxes(F.count("*").alias("_n"))).withColumn("last", last).drop("_n")))
        marked = rest.join(_small(levels[-1].select("cell", "last")), "cell")
        here = marked.where("last").select("x", "y", F.lit(bits).alias("bits"), "cell")
        done = here if done is None else done.unionByName(here)
        if levels[-1].where("not last").isEmpty():
            return levels, done, cell
        rest = saved(marked.where("not last").select("x", "y"))


def _nearest(places: DataFrame, points: DataFrame, leaf: int) -> DataFrame:
    """x, y and distance to the nearest of the points, for distinct places; both tables have rows.

    The box of the deepest cell that holds a place (or the place of the tree's edge next to it) bounds its distance. Then all places
    go down the tree together: a level's cells are joined by their parent, and of a place's cells those stay whose box begins no farther
    than the nearest one ends. In the last cells points are measured.
    """
    levels, dealt, cell = _tree(points, leaf)
    levels = [_small(level.select("parent", F.struct("cell", F.lit(i * STEP).alias("bits"), "last", *(f"{n}_{c}" for n in ("low", "high") for c in "xy")).alias("c"))) for i, level in enumerate(levels, 1)]
    gap = lambda c: F.greatest(F.col(f"c.low_{c}") - F.col(c), F.col(c) - F.col(f"c.high_{c}"), F.lit(0.0))
    end = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"c.low_{c}")), F.abs(F.col(c) - F.col(f"c.high_{c}")))
    square = lambda f: f("x") * f("x") + f("y") * f("y")
    # Places are dealt once; with cells broadcast, all levels are one stage, as each place's cells stay together.
    kept = places.repartition("x", "y").select("x", "y", F.lit(float("inf")).alias("_best"))
    for i, level in enumerate(levels, 1):
        kept = kept.withColumn("_own", cell(i * STEP)).join(level, F.col("_own") == F.col("c.cell"), "left").select("x", "y", F.least("_best", square(end)).alias("_best"))
    kept = kept.withColumns({"cell": F.lit(0).cast("long"), "bits": F.lit(0), "last": F.lit(False), "_near": F.lit(0.0)})
    for level in levels:  # a last cell stays as it is
        below = kept.withColumn("parent", F.when(~F.col("last"), F.col("cell"))).join(level, "parent", "left").where("last or c is not null")
        sized = below.select("x", "y", *(F.coalesce(f"c.{n}", n).alias(n) for n in ("cell", "bits", "last")), F.coalesce(square(gap), F.col("_near")).alias("_near"), square(end).alias("_far"), "_best").where("_near <= _best")
        best = F.least(F.col("_best"), F.min("_far").over(Window.partitionBy("x", "y")))
        kept = sized.withColumn("_best", best).where("_near <= _best").drop("_far")
    spots = _small(dealt.select(F.col("x").alias("right_x"), F.col("y").alias("right_y"), "bits", "cell"))
    met = kept.join(spots, ["bits", "cell"])
    return met.groupBy("x", "y").agg(F.sqrt(F.min(distance2(F.col("x"), F.col("y"), F.col("right_x"), F.col("right_y")))).alias("distance"))


def min_distance(query: DataFrame, reference: DataFrame, key: str, *, leaf: int = 16) -> DataFrame:
    """Every query row with ``distance`` to the nearest reference point: infinite if there is none, null for rows without both coordinates (or NaN).

    Rows are known by their place, so repeated and null keys do no harm, and equal places are looked up once. A place meets the
    points of those last cells (at most ``leaf`` points each) of an adaptive tree whose box can hold its nearest.
    """
    rows = query.select(key, "x", "y")
    places, points = saved(placed(rows).select("x", "y").distinct()), saved(placed(reference).select("x", "y").distinct())
    if points.isEmpty() or places.isEmpty():
        finite = rows.join(places.withColumn("_in", F.lit(True)), ["x", "y"], "left")
        return finite.select(key, "x", "y", F.when(F.col("_in"), F.lit(float("inf"))).alias("distance"))
    return rows.join(_nearest(places, points, leaf), ["x", "y"], "left").select(key, "x", "y", "distance")


def _split(points: DataFrame, level: int) -> DataFrame:
    """Cells of a level (cx, cy) with their parent (px, py), tight box, distinct points and summed weights."""
    at = lambda c, k: F.shiftright(c, BITS - k)
    rows = points.groupBy(at("_fx", level).alias("cx"), at("_fy", level).alias("cy")).agg(*_boxes(F.count("*").alias("places"), F.sum("n").alias("n"), F.sum("w").alias("w")))
    return rows.withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})


def neighbour_sums(df: DataFrame, r: float, weight: Column, leaf: int = 16) -> DataFrame:
    """x, y, n and w for each distinct place: rows at most r away (its own among them), and their summed weight.

    Cells of side r meet their neighbours; of a pair whose boxes are wholly within r the one counts for all points of the other at once,
    and a pair wholly outside is left. Only pairs on the rim are halved and looked at again, until both cells have at most ``leaf``
    places, which are tested by themselves. So the pairs grow with the rim, not with the area.
    """
    fine = lambda c: F.floor(F.col(c) / r * (1 << BITS))
    points = saved(placed(df).groupBy("x", "y").agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("w")).withColumns({"_fx": fine("x"), "_fy": fine("y")}))
    side = lambda t, p: t.select(*(F.col(c).alias(f"{p}_{c}") for c in t.columns))
    gap = lambda c: F.greatest(F.col(f"a_low_{c}") - F.col(f"b_high_{c}"), F.col(f"b_low_{c}") - F.col(f"a_high_{c}"), F.lit(0.0))
    end = lambda c: F.greatest(F.abs(F.col(f"a_high_{c}") - F.col(f"b_low_{c}")), F.abs(F.col(f"b_high_{c}") - F.col(f"a_low_{c}")))
    square = lambda f: f("x") * f("x") + f("y") * f("y")
    kind = F.when(square(end) <= r * r, "inside").when((F.col("a_places") <= leaf) & (F.col("b_places") <= leaf), "tested").otherwise("rim")

    def looked_at(pairs: DataFrame) -> DataFrame:
        found = pairs.where(square(gap) <= r * r).select("a_cx", "a_cy", "b_cx", "b_cy", F.col("b_n").alias("n"), F.col("b_w").alias("w"), kind.alias("kind"))
        return saved(found)

    cells = _split(points, 0)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    beside = side(cells, "a").withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    level, pairs, counted, tested = 0, looked_at(beside.join(side(cells, "b"), (F.col("a_cx") + F.col("_dx") == F.col("b_cx")) & (F.col("a_cy") + F.col("_dy") == F.col("b_cy")))), [], []
    while True:
        counted.append(pairs.where("kind = 'inside'").groupBy("a_cx", "a_cy").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select(F.lit(level).alias("level"), F.col("a_cx").alias("cx"), F.col("a_cy").alias("cy"), "n", "w"))
        rim = pairs.where("kind = 'rim'").select("a_cx", "a_cy", "b_cx", "b_cy")
        ends = pairs.where("kind = 'tested'" if level < BITS else "kind <> 'inside'").select("a_cx", "a_cy", "b_cx", "b_cy")
        spots = points.withColumns({"cx": F.shiftright("_fx", BITS - level), "cy": F.shiftright("_fy", BITS - level)}).select("cx", "cy", "x", "y", "n", "w")
        near = ends.join(side(spots, "a"), ["a_cx", "a_cy"]).join(side(spots, "b"), ["b_cx", "b_cy"]).where(distance2(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= r * r)
        tested.append(near.select(F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("b_n").alias("n"), F.col("b_w").alias("w")))
        if level == BITS or rim.isEmpty():
            break
        level += 1
        cells = _split(points, level)
        renamed = lambda p: side(cells, p).withColumnsRenamed({f"{p}_px": f"{p}p_cx", f"{p}_py": f"{p}p_cy"})
        down = rim.toDF("ap_cx", "ap_cy", "bp_cx", "bp_cy").join(renamed("a"), ["ap_cx", "ap_cy"]).join(renamed("b"), ["bp_cx", "bp_cy"])
        pairs = looked_at(down)
    by_cell, by_place = counted[0], tested[0]
    for c, t in zip(counted[1:], tested[1:], strict=True):
        by_cell, by_place = by_cell.unionByName(c), by_place.unionByName(t)
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("_fx", BITS - k).alias("cx"), F.shiftright("_fy", BITS - k).alias("cy")) for k in range(level + 1))))
    whole = points.select("x", "y", own.alias("own")).select("x", "y", "own.*").join(by_cell, ["level", "cx", "cy"]).select("x", "y", "n", "w")
    return whole.unionByName(by_place).groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def neighbours(df: DataFrame, key: str, r: float) -> DataFrame:
    """Pairs (key, right_<key>) at most r apart, each row with itself included."""
    points = df.select(key, "x", "y")
    return distance_join(points, points, r).select(key, f"right_{key}")


def near_summary(points: DataFrame, others: DataFrame, key: str, r: float) -> DataFrame:
    """key, n, first: for each key of ``points``, how many rows of ``others`` are at most r away, and the least key of them; keys without any are left out.

    Rows of a place are counted before they are joined, so the pairs are those of distinct places.
    """
    counted = placed(others).groupBy("x", "y").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    pairs = distance_join(counted, placed(points).select("x", "y").distinct(), r)
    found = pairs.groupBy(F.col("right_x").alias("x"), F.col("right_y").alias("y")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return points.select(key, "x", "y").join(found, ["x", "y"]).groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def near_labels(df: DataFrame, label: str, r: float) -> DataFrame:
    """x, y and label, distinct: the labels of rows at most r from each distinct place.

    Places and labels are made distinct first. In cells of side r / 2 a label in the place's own cell is near without a test, and so is one
    whose box in a cell around is wholly near the box of the place's cell; only labels that no cell gives are looked at point by point.
    """
    half = r / 2
    at = {"_cx": F.floor(F.col("x") / half), "_cy": F.floor(F.col("y") / half)}
    points = saved(placed(df).where(F.col(label).isNotNull()).select("x", "y", F.col(label).alias("label")).distinct().withColumns(at))
    places = saved(placed(df).select("x", "y").distinct().withColumns(at))
    side = lambda t, p: t.select(*(F.col(c).alias(f"{p}_{c}") for c in t.columns))
    around = F.array(*(F.lit(i) for i in range(-3, 4)))  # a box may begin 2 cells away, and rounding may add one
    theirs = points.groupBy("_cx", "_cy", "label").agg(*_boxes()).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    theirs = side(theirs.withColumns({"ax": F.col("_cx") - F.col("_dx"), "ay": F.col("_cy") - F.col("_dy")}).drop("_dx", "_dy"), "b")
    ours = side(places.groupBy("_cx", "_cy").agg(*_boxes()), "a")
    gap = lambda c: F.greatest(F.col(f"a_low_{c}") - F.col(f"b_high_{c}"), F.col(f"b_low_{c}") - F.col(f"a_high_{c}"), F.lit(0.0))
    end = lambda c: F.greatest(F.abs(F.col(f"a_high_{c}") - F.col(f"b_low_{c}")), F.abs(F.col(f"b_high_{c}") - F.col(f"a_low_{c}")))
    square = lambda f: f("x") * f("x") + f("y") * f("y")
    pairs = ours.join(theirs, (F.col("a__cx") == F.col("b_ax")) & (F.col("a__cy") == F.col("b_ay"))).where(square(gap) <= r * r)
    # Of each cell and label: whether it is near as a whole, and the cells to test else.
    whole = F.bool_or(square(end) <= r * r)
    cells_ = saved(pairs.groupBy(F.col("a__cx").alias("_cx"), F.col("a__cy").alias("_cy"), F.col("b_label").alias("label")).agg(whole.alias("whole"), F.collect_list(F.struct(F.col("b__cx").alias("cx"), F.col("b__cy").alias("cy"))).alias("beside")))
    given = places.join(cells_.where("whole").select("_cx", "_cy", "label"), ["_cx", "_cy"]).select("x", "y", "label")
    open_ = cells_.where("not whole").select("_cx", "_cy", "label", F.explode("beside").alias("b")).select("_cx", "_cy", "label", "b.cx", "b.cy")
    there = points.select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "label", F.col("x").alias("bx"), F.col("y").alias("by"))
    tested = open_.join(there, ["cx", "cy", "label"]).join(places, ["_cx", "_cy"]).where(distance2(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= r * r)
    return given.unionByName(tested.select("x", "y", "label").distinct()).withColumnRenamed("label", label)


def fold_census(df: DataFrame, key: str, r: float) -> DataFrame:
    """For each row as a fold of its own: rows excluded within r, rows and positives left to train on, whether it is usable. Rows without a place are left out."""
    rows = df.select(key, "x", "y")
    near = rows.join(neighbour_sums(df, r, F.col("target")), ["x", "y"])
    totals = df.agg(F.count("*").alias("_n"), F.sum("target").alias("_all"))
    n_train, n_pos = F.col("_n") - F.col("n"), F.col("_all") - F.col("w")
    counted = near.crossJoin(F.broadcast(totals)).select(key, F.col("n").alias("n_excluded"), n_train.alias("n_train"), n_pos.alias("n_train_pos"))
    return counted.withColumn("usable", F.col("n_train_pos").between(F.lit(1), F.col("n_train") - 1))
