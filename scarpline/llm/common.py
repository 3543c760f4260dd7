"""What the operators of this subpackage share: table access, shared scratch space and word patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.sources.tables import saved, scratch  # noqa: F401  for the modules of this subpackage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives no words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", " " * 5), " "), "")


def n_words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], size: int = 6_000_000, column: int = -1) -> Iterator[pa.RecordBatch]:
    """The rows in slices with about so many bytes in a column of strings: small batches are put together, large ones cut."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(batch.num_rows, int(np.searchsorted(ends, before + size - total)) + 1)
            held.append(batch.slice(first, last - first))
            total, first = total + int(ends[last - 1]) - before, last
            if total >= size or sum(b.num_rows for b in held) >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Jobs that are run inside hand so many rows at a time to Python: large rows make large batches, in the executor and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def release_memory() -> None:
    """Give memory that this worker has freed back to the machine, as Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that ends with ``release_memory``."""

    @wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts after each other, and where each text's begin (one number more than texts).

    Each different word is hashed once; nothing is kept from call to call. Null has no words.
    """
    import xxhash

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    known = words.flatten().dictionary_encode()
    different = known.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    at, begins = known.indices.to_numpy(), words.offsets.to_numpy().astype(np.int64)
    if b"" in different:  # white space at a text's ends makes empty words
        some = at != different.index(b"")
        begins, at = np.append(0, np.cumsum(some))[begins], at[some]
    return hashes[at], begins


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, given the hashes of the words."""
    if len(words) < n:
        return words[:0]
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mixed(out)
