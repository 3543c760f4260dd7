"""Mixing sources to target weights by Pareto order sampling.

``source_targets`` shares the words of all documents among sources by weight; no source gets more than ``most`` times its
own words, the excess goes to the others by weight. ``mix`` then gives each document of a source with rate r = target /
words floor(r) certain whole copies. What is left of the target is drawn once, with one more copy at most for a document:
inclusion probabilities are in proportion to ``preference``, none above 1, such that the words expected are those that are
left. Documents are ranked by Pareto's order, random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken
along it as long as they fit into what is left; one that does not fit is passed over.

The size that is fixed is that of the sample in words. A source ends when it is within a thousandth of its target or when
no document fits any more; then the smallest document that is too large is taken if that comes nearer to the target. So
the error is at most half of the smallest document that was left out, or a thousandth of the target.

u is a hash of id and seed: reruns agree, whatever the partitions. Null texts have size 0, are ranked as others and add
no words. Documents of any length are whole. Documents with a null source are a source of their own, the last. Rows that share id,
source and size are told apart by their place in the order of a hash of all their columns, so each is taken or not by itself. A preference that is
null or not above 0 comes last. Empty tables give empty tables. Input columns that clash with those added are replaced.

Sources are counted on the driver: their number, unlike that of documents, is small (a few numbers for each, and one for
each eighth of an octave of preferences). Ranks are not computed by sorting a source in one task: documents fall into ranges
of the order, whose word totals tell which ranges are taken whole; only the range at the border is ranked by itself.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators.select import bucket_edges, bucket_of

from .common import saved

#: Steps of preferences in an octave.
STEPS = 8


def capped_shares(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``most`` times its size; what is above is shared anew by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = most * float(sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target for a table with source and size; weights repeat over the sources by code point, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # one row for each source
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    targets = capped_shares([r["source_size"] for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], most)
    return sized.sparkSession.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(rows, targets, strict=True)], "source string, source_size long, target double")


def capped_scale(words: dict[int, int], budget: float) -> float:
    """c such that min(1, c * 2 ** (level / STEPS)) of the words of each level sum to the budget; infinite if it takes all."""
    left, open_ = budget, sorted(((level, n) for level, n in words.items() if n > 0), reverse=True)
    while open_:
        rest = sum(2 ** (level / STEPS) * n for level, n in open_)
        c = left / rest
        level, n = open_[0]
        if c * 2 ** (level / STEPS) <= 1:
            return c
        left, open_ = left - n, open_[1:]  # the most preferred are certain
    return float("inf")


def _front(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """The rows taken from the front of each source's order while their sizes, summed up, stay within its ``budget``.

    rows: KEY, order and _range (by the order); budget: source, budget.
    """
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words")).withColumn("_upto", F.sum("_words").over(upto)).join(F.broadcast(budget), "source")
    ranges = ranges.select("source", "_range", (F.col("_upto") <= F.col("budget")).alias("_whole"), (F.col("budget") - (F.col("_upto") - F.col("_words"))).alias("_room")).where("_whole or _room >= 0")
    # At most BUCKETS rows for each source.
    marked = rows.join(F.broadcast(ranges), ["source", "_range"])
    inside = Window.partitionBy("source", "_range").orderBy("order", *KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = marked.where(~F.col("_whole")).withColumn("_sum", F.sum("size").over(inside)).where("_sum <= _room")
    return marked.where("_whole").select(*KEY).unionByName(border.select(*KEY))


KEY = ["source", "key", "size", "nth"]


def _keyed(rows: DataFrame, doc_id: str, source: str, size: Column, preference: Column | None) -> DataFrame:
    """Add columns, none of them null, that tell all rows apart: key, size, nth (among rows equal in the others) and _source."""
    named = rows.withColumns({"_source": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")), "_key": F.xxhash64(F.col(doc_id).isNull(), doc_id), "_size": size.cast("long"), "_preference": F.lit(1.0) if preference is None else preference.cast("double")})
    # Rows that share id, source and size are numbered by their content, so that reruns number them alike; rows equal in all are interchangeable.
    hashed = [f.name for f in rows.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    whole = F.xxhash64(*hashed, *(F.col(c).isNull() for c in hashed))
    return named.withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_key", "_size").orderBy(doc_id, "_preference", whole)))


def mix(docs: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, preference: Column | None = None, seed: int = 7) -> DataFrame:
    """One row for each document row: id, size, source_size, target, copies, probability and order of the draw, and the columns of KEY, which tell rows apart."""
    spark = docs.sparkSession
    keyed = _keyed(docs, doc_id, source, size, preference)
    level = F.when(F.col("_preference") > 0, F.round(F.log2("_preference") * STEPS).cast("int"))
    found = saved(keyed.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("name"), F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_nth").alias("nth"), level.alias("level")), "sizes")
    targets = source_targets(found.select(F.col("name").alias("source"), "size"), weights, most)
    words: dict[str, dict[int, int]] = {}
    for r in found.where("level is not null").groupBy("source", "level").agg(F.sum("size").alias("n")).collect():  # some hundred rows for each source
        words.setdefault(r["source"], {})[r["level"]] = r["n"]
    drawn = []
    for r in targets.collect():
        name = "n" if r["source"] is None else "s" + r["source"]
        certain = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        budget = r["target"] - certain * r["source_size"]
        scale = capped_scale(words.get(name, {}), budget) if budget > 0 else 0.0
        drawn.append((name, r["source_size"], r["target"], certain, budget, min(scale, 1e18)))
    plan = spark.createDataFrame(drawn, "source string, source_size long, target double, certain int, budget double, scale double")
    p = F.least(F.greatest(F.coalesce(F.col("scale") * F.pow(F.lit(2.0), F.col("level") / STEPS), F.lit(0.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = (F.shiftrightunsigned(F.xxhash64("key", "size", "nth", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rated = found.join(F.broadcast(plan), "source").withColumn("probability", p).withColumn("order", u / (1 - u) * (1 - F.col("probability")) / F.col("probability"))
    able = rated.where("budget > 0").select(*KEY, "order")
    edges = able.groupBy("source").agg(bucket_edges(F.col("order")).alias("_edges"))
    able = saved(able.join(F.broadcast(edges), "source").withColumn("_range", bucket_of(F.col("order"), F.col("_edges"))).drop("_edges"), "order")
    budget = plan.where("budget > 0").select("source", "target", "budget")
    spare, taken = able, able.limit(0).select(*KEY)
    while True:
        step = saved(_front(spare, budget.select("source", "budget")), "taken")
        taken = taken.unionByName(step)
        used = step.groupBy("source").agg(F.sum("size").alias("_used"))
        budget = saved(budget.join(used, "source", "left").select("source", "target", (F.col("budget") - F.coalesce("_used", F.lit(0))).alias("budget")), "budget")
        # Each pass takes what comes before the first document that does not fit; all larger ones are out from then on.
        short = budget.where("budget > 0.001 * target")
        left = spare.join(step, KEY, "left_anti")
        spare = saved(left.join(F.broadcast(short), "source").where((F.col("size") > 0) & (F.col("size") <= F.col("budget"))).select(*able.columns), "spare")
        if spare.isEmpty():
            break
    near = able.join(F.broadcast(short), "source").where("size > budget and size < 2 * budget").join(taken, KEY, "left_anti")
    last = near.groupBy("source").agg(F.min(F.struct("size", "order", "key", "nth")).alias("m")).select("source", "m.key", "m.size", "m.nth")
    more = taken.unionByName(last.select(*KEY)).withColumn("_more", F.lit(1))
    once = rated.join(more, KEY, "left")
    return once.select("id", "source_size", "target", (F.col("certain") + F.coalesce("_more", F.lit(0))).alias("copies"), "probability", "order", *KEY)


def mixed_rows(docs: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", preference: Column | None = None, **options) -> DataFrame:
    """The mix itself: each document row as often as it is taken, with its own columns."""
    taken = mix(docs, size, doc_id=doc_id, source=source, preference=preference, **options).where("copies > 0")
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col("copies").alias("_copies"))
    rows = _keyed(docs, doc_id, source, size, preference).join(taken, [f"_{c}" for c in KEY])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
