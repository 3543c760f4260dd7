"""Sharding by weighted rendezvous hashing.

Each shard gives each key a score ``-weight / ln(u)``, u being a uniform hash of key and shard; the key goes to the
shard of the highest score. A shard's chance is its weight's share, and a further shard takes keys only into itself,
for the scores of the others stay as they are.

Null keys are hashed as one key of their own, the string "~". Repeated keys share a shard. Empty tables give empty tables. Input columns
whose names clash with those added are replaced by the added ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(key: Column, salt: str) -> Column:
    """52 bits of a hash that any SQL engine computes alike."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("~")), F.lit(f"/{salt}"))), 1, 13), 16, 10).cast("long")


def _unit(key: Column, salt: str) -> Column:
    """A hash in the open interval from 0 to 1."""
    return (_number(key, salt).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to ``len(weights) - 1``) that a key goes to; weights are above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights: one number above 0 for each shard")
    scores = [F.struct((F.lit(-float(w)) / F.log(_unit(key, str(i)))).alias("score"), F.lit(-i).alias("rank")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores)).getField("rank")).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = (), buckets: int = 1024) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's gapless number from 0 within its shard.

    A shard's rows are cut into ``buckets`` by a hash of the key; each bucket is numbered by itself and moved up by the
    rows of the buckets before it. The offsets (shards times buckets rows) are all that is broadcast. order: further
    columns that make the numbers of rows with one key repeatable; rows equal in these too are interchangeable.
    """
    dealt = df.withColumns({"shard": rendezvous(F.col(key), weights), "_bucket": (_number(F.col(key), "slot") % buckets).cast("int")})
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, *order)
    numbered = dealt.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "_bucket"]).withColumn("slot", F.col("slot") + F.col("_offset")).drop("_bucket", "_offset")


def write_shards(df: DataFrame, path: str) -> None:
    """Write sharded rows, one folder for each shard, files in slot order; a hot shard is still written by many tasks."""
    df.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
