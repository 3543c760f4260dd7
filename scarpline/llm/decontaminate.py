"""Benchmark decontamination, from DataFrame functions alone.

The windows of ``n`` words of all benchmark items are broadcast as a hash table, with a hash filter of fixed size before
it: the windows of each document are scanned against the filter, and those that pass are looked up by all their words.
Items with fewer words than ``n`` are one window of their own length.

The window table is broadcast only if it has at most ``broadcast_windows`` rows; a larger one is joined by shuffle.

Null and empty texts have no words, items without words no windows. Repeated document rows each get their result;
repeated items count once. An item without id marks words but is not counted or listed. Empty tables give empty tables
or no hits. Columns other than those named are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are made of ASCII letters, in lower case, ASCII digits and all beyond ASCII.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")
#: Bits of the filter before the hash table; more windows than this only make it let more through.
BITS = 1 << 18
#: Windows of a document that are looked at in one row.
CHUNK = 2000


def item_words(text: Column) -> Column:
    """The words of a normalised text; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _LETTERS + _BREAKS, _LETTERS.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _probe(word, size: int) -> Column:
    """A hash of three words of a window, given a function from places in the window to words."""
    return F.xxhash64(word(0), word(size // 2), word(size - 1))


def benchmark_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Distinct windows of all items: run (its words joined by a space), size, items (array of ids as strings)."""
    each = items.select(F.col(item_id).cast("string").alias("item"), item_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = each.withColumn("size", F.least(F.size("w"), F.lit(n)))
    runs = each.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("run"))
    return runs.groupBy("run", "size").agg(F.collect_set("item").alias("items"))


def _filter_bits(windows: DataFrame, size: int) -> Column:
    """A hash filter of fixed size: bit ``probe mod BITS`` is set for each window. At most BITS numbers reach the driver."""
    parts = F.split("run", " ")
    at = F.pmod(_probe(lambda k: F.element_at(parts, k + 1), size), F.lit(BITS))
    cells = [0] * (BITS // 64)
    for r in windows.where(F.col("size") == size).select(at.alias("at")).distinct().collect():
        cells[r["at"] >> 6] |= 1 << (r["at"] & 63)
    return F.lit([c - (1 << 64) if c >> 63 else c for c in cells]).cast("array<bigint>")


def _survivors(part: str, size: int, bits: Column) -> Column:
    """The windows of an array of words that pass the filter, as (at, run)."""
    words = F.col(part)

    def passes(x: Column) -> Column:
        return F.bit_get(F.get(bits, F.shiftright(x["h"], 6)), F.pmod(x["h"], F.lit(64))) == 1

    starts = F.when(F.size(part) >= size, F.sequence(F.lit(0), F.size(part) - size)).otherwise(F.array().cast("array<int>"))
    probed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.pmod(_probe(lambda k: F.get(words, i + k), size), F.lit(BITS)).cast("int").alias("h")))
    return F.transform(F.filter(probed, passes), lambda x: F.struct(x["at"].alias("at"), F.array_join(F.slice(words, x["at"] + 1, size), " ").alias("run")))


def window_hits(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, broadcast_windows: int = 500_000) -> DataFrame:
    """One row for each distinct document (doc_id, _key: a hash of the text) that has hits: spans, an array of (at, size), and items.

    A document's words are scanned in chunks of CHUNK windows, so that a long text needs no more memory than a short one.
    """
    found = benchmark_windows(items, item_id, item_text, n).cache()
    sizes = found.groupBy("size").count().collect()  # n rows at most
    joined = F.broadcast(found) if sum(r["count"] for r in sizes) <= broadcast_windows else found
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_key"), item_words(F.col(text)).alias("w"))
    parts = []
    for size in sorted(r["size"] for r in sizes) or [n]:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(CHUNK)), lambda i: F.struct(i.alias("base"), F.slice("w", i + 1, CHUNK + size - 1).alias("part")))
        chunks = base.select("doc_id", "_key", F.explode(cut).alias("c")).select("doc_id", "_key", "c.base", "c.part")
        seen = chunks.select("doc_id", "_key", "base", F.explode(_survivors("part", size, _filter_bits(found, size))).alias("x"))
        parts.append(seen.select("doc_id", "_key", (F.col("base") + F.col("x.at")).alias("at"), F.lit(size).alias("size"), F.col("x.run").alias("run")).join(joined, ["run", "size"]))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every document row with its other columns and ``n_words``, ``spans`` (word positions found), ``n_hit`` and ``items``.

    Keep documents with ``n_hit`` 0, or cut the spans out, as the corpus needs it.
    """
    hits = window_hits(docs, items, doc_id=doc_id, text=text, **options)
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_hash"), "spans", "items", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))).cast("long").alias("_hit"))
    rows = docs.drop("n_words", "spans", "items", "n_hit").withColumns({"_key": F.xxhash64(text), "n_words": F.size(item_words(F.col(text))).cast("long")})
    joined = rows.join(hits, F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<at:int,size:int>>")
    return joined.withColumns({"n_hit": F.coalesce("_hit", F.lit(0)).cast("long"), "spans": F.coalesce("spans", none), "items": F.coalesce("items", F.array().cast("array<string>"))}).drop("_doc", "_hash", "_hit", "_key")
