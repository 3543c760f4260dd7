"""Similarity join of documents by the Jaccard index of their word n-grams, as a blocked sparse matrix product.

The incidence matrix of documents by n-grams is cut into blocks: some thousand documents by one range of n-gram hashes.

1. Each block's n-grams meet the blocks of all other documents in the same range, and get their document counts. Those of
   one document alone can't add to any overlap and go. Blocks send each n-gram once, with its count, so that one that very
   many documents have is as many entries as there are blocks.
2. The rest returns to its documents. A document whose remaining n-grams are fewer than the share ``threshold`` of its
   size can't link with any other, by its size alone, and goes; of large corpora this leaves the near copies.
3. Documents of equal sets become one row. Of each row the rarest ``rest - ceil(threshold * size) + 1`` n-grams are
   indexed: a linked pair shares one of them (the prefix bound). Each index entry has a pivot; rows that share an entry
   are members of its pivot's group, so all pairs that meet in the index meet in a group.
4. Each member is compared with its pivot. Members that aren't linked to it are compared with all others of the group, by
   products of blocks of the reduced matrix; overlaps are accumulated inside the task, pairs below the bound stay there,
   and of the links a spanning forest comes out.

So components are exact: all pairs that can link have been compared, but for pairs of one component. No pairs of a group
are emitted: rows grow with its members. The products' arithmetic grows with the square of those members of a group that
aren't linked to their pivot.

Null, empty and blank texts have empty sets and are linked with nothing. A text of fewer words than ``n`` has its whole
sequence as the only n-gram. Repeated rows, and rows of one id, are documents of their own, linked if their sets are.
A null id counts as no id when the smallest of a component is sought. N-grams and sets are known by 64-bit hashes. Empty
tables give empty tables. Columns other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, rows_per_batch, saved, slices, trimmed, word_hashes

#: Stands for the document of an n-gram that several documents of a block have.
SEVERAL = 0xFFFF


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words."""
    words, begins = word_hashes(pc.ascii_lower(pc.fill_null(texts, "")))
    grams = gram_hashes(words, n)
    ends = itertools.pairwise(begins.tolist())
    return [np.unique(grams[a : b - n + 1]) if b - a >= n else gram_hashes(words[a:b], b - a) if b > a else words[:0] for a, b in ends]


_INCIDENCE = "batch long, range int, docs array<long>, keys array<long>, sizes array<long>, sets array<long>, idx binary, hash binary, count binary"
_KINDS = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4, *[pa.binary()] * 3]
_NAMES = [c.split()[0] for c in _INCIDENCE.split(", ")]


def runs(ordered: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each different value of an ordered array, and where it stands."""
    values, starts = np.unique(ordered, return_index=True)
    for value, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)][: len(values)], strict=True):
        yield value, slice(a, b)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _blocks(docs: DataFrame, doc_id: str, text: str, n: int, ranges: int, block: int) -> DataFrame:
    """The incidence matrix in blocks, each cut into ranges of hashes: an n-gram of one document with that document's number,
    one of several documents once, with their count. The block's documents, and which of them share n-grams, are one row more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        keys: list = []
        sets: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            import xxhash

            sizes = [len(s) for s in sets]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64).tolist()
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            sets.clear()
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else order
            count = np.diff(np.append(starts, len(every))).astype(np.uint32)
            within = np.repeat(count > 1, count)
            yield _batch([(number, number % ranges, list(ids), list(keys), sizes, names, owner[within].tobytes(), None, count[count > 1].astype(np.uint16).tobytes())])
            every, owner = every[starts], np.where(count > 1, np.uint16(SEVERAL), owner[starts])
            place = ((every >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.lexsort((owner, place))  # runs of one document pack better
            every, owner, count, place = every[order], owner[order], count[order], place[order]
            rows = []
            for r, part in runs(place):
                rows.append((number, r, None, None, None, None, owner[part].tobytes(), every[part].tobytes(), count[part][owner[part] == SEVERAL].tobytes()))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in slices(batches):
            for doc, key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), n), strict=True):
                ids.append(doc)
                keys.append(key)
                sets.append(found)
                total += len(found)
                if total >= block or len(ids) == 65_000:
                    yield from flush()
                    ids, keys, total, number = [], [], 0, number + 1
        if ids:
            yield from flush()

    content = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(content), content).mapInArrow(trimmed(run), _INCIDENCE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range, which stand together: n-grams of one document go, others get their counts."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(r[7], np.uint64) for r in rows]
        every = np.concatenate(hashes)
        owner = np.concatenate([np.frombuffer(r[6], np.uint16) for r in rows])
        count = np.ones(len(every), np.uint32)
        count[owner == SEVERAL] = np.concatenate([np.frombuffer(r[8], np.uint32) for r in rows])
        order = np.argsort(every)
        ordered = every[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.add.reduceat(count[order], starts)
        count[order] = np.repeat(total, np.diff(np.append(starts, len(ordered))))
        at, out = 0, []
        for r, h in zip(rows, hashes, strict=True):
            c, o = count[at : at + len(h)], owner[at : at + len(h)]
            at += len(h)
            more = c > 1
            if more.any():
                out.append((r[0], r[1], None, None, None, None, o[more].tobytes(), h[more].tobytes(), c[more].tobytes()))
            if len(out) == 256:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] is not None:
                yield _batch([row])
                continue
            if held and held[-1][1] != row[1]:
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


_REDUCED = "doc_id long, key long, size long, set long, rest array<long>"


def _reduced(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Documents of one block, which stand together, with what is left of their n-grams, rarest first; null if too few are left."""

    def flush(docs: tuple, rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array(docs[4], np.int64)
        rest: list = [None] * len(sizes)
        if rows:
            idx, hashes, count = (np.concatenate([np.frombuffer(r[i], k) for r in rows]) for i, k in ((6, np.uint16), (7, np.uint64), (8, np.uint32)))
            several = idx == SEVERAL
            # N-grams of several documents of the block all come back; by their hashes, the row of documents says how many and which.
            order, lengths = np.argsort(hashes[several]), np.frombuffer(docs[8], np.uint16)
            inside, counts = np.repeat(hashes[several][order], lengths), np.repeat(count[several][order], lengths)
            idx, hashes, count = np.append(idx[~several], np.frombuffer(docs[6], np.uint16)), np.append(hashes[~several], inside), np.append(count[~several], counts)
            left = np.bincount(idx, minlength=len(sizes))
            enough = (left > 0) & (100 * left >= percent * sizes)
            some = enough[idx]
            idx, hashes, count = idx[some], hashes[some], count[some]
            order = np.lexsort((hashes, count, idx))
            idx, hashes = idx[order], hashes[order].view(np.int64)
            cuts = np.searchsorted(idx, np.arange(len(sizes) + 1))
            for i in np.flatnonzero(enough):
                rest[i] = hashes[cuts[i] : cuts[i + 1]]
        columns = [pa.array(docs[2], pa.int64()), pa.array(docs[3], pa.int64()), pa.array(sizes), pa.array(docs[5], pa.int64()), pa.array(rest, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "size", "set", "rest"])

    docs, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] is not None:  # comes first of its block
                if docs is not None:
                    yield flush(docs, held)
                docs, held = row, []
            else:
                held.append(row)
    if docs is not None:
        yield flush(docs, held)


def reduced_sets(docs: DataFrame, *, doc_id: str, text: str, n: int, percent: int, block: int = 1_200_000, range_bytes: int = 10_000_000, tasks: int = 20_000) -> DataFrame:
    """One row for each document row: doc_id, key (a hash of the text), size (of its set), set (the set's hash), rest (n-grams left, rarest first, or null).

    A range holds the n-grams of ``range_bytes`` of text; beyond ``tasks`` ranges a task counts several, one after the other.
    """
    spark = docs.sparkSession
    amount = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, -(-amount // range_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with rows_per_batch(spark, 48):
        blocks = _blocks(docs, doc_id, text, n, ranges, block)
        counted = blocks.repartitionById(min(ranges, tasks), F.col("range") % min(ranges, tasks)).sortWithinPartitions("range").mapInArrow(trimmed(_counted), _INCIDENCE)
        back = counted.repartition(parts, "batch").sortWithinPartitions("batch", F.col("docs").isNull())
        return saved(back.mapInArrow(trimmed(lambda b: _reduced(b, percent)), _REDUCED), "sets")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for a table of edges (a, b); by neighbours' smallest roots and pointer jumping."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("new"), "root")
        jump = roots.select(F.col("node").alias("new"), F.col("root").alias("far"))
        moved = saved(step.join(jump, "new", "left").select("node", F.least("new", "far").alias("new"), "root"), "roots")
        roots = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return roots


def _products(table: pa.Table, percent: int) -> pa.Table:
    """Edges (a, b) that connect what is linked in one pair of blocks: columns set, size, rest, side (0 or 1, 2 in both blocks).

    The product of the rows' incidence matrix and its transpose is accumulated column by column: columns of many rows as
    dense products, those of few by their pairs. Nothing but the edges of a spanning forest leaves the task.
    """
    sets, sizes, side = (table.column(c).to_numpy() for c in ("set", "size", "side"))
    rest = table.column("rest").combine_chunks()
    values, offsets = rest.flatten().to_numpy(), np.cumsum([0, *rest.value_lengths().to_numpy()])
    m = len(sets)
    overlap = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    ordered, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    lengths = np.diff(np.append(starts, len(ordered)))
    for length in np.unique(lengths[lengths < 24]):
        if length > 1:
            rows = owner[starts[lengths == length][:, None] + np.arange(length)]
            at = (rows[:, :, None] * m + rows[:, None, :]).ravel()
            overlap += np.bincount(at, minlength=m * m).reshape(m, m)
    heavy = np.flatnonzero(lengths >= 24)
    for i in range(0, len(heavy), 1024):
        part = heavy[i : i + 1024]
        dense = np.zeros((m, len(part)), np.float32)
        for j, k in enumerate(part):
            dense[owner[starts[k] : starts[k] + lengths[k]], j] = 1
        overlap += dense @ dense.T
    linked = 100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap)
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(np.triu(linked, 1) & ~((side[:, None] == side[None, :]) & (side[:, None] != 2))), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
    ends = np.array([find(x) for x in range(m)])
    some = ends != np.arange(m)
    return pa.table({"a": pa.array(sets[some], pa.int64()), "b": pa.array(sets[ends[some]], pa.int64())})


def _block_edges(members: DataFrame, rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges among the members of pivots' groups, without comparing those that are linked to the pivot with each other.

    members: pivot, set, linked. Members that aren't linked to the pivot are cut into blocks, and so are the others; each block
    of the former meets itself, the later ones, and all of the latter. A task holds two blocks.
    """
    counts = members.groupBy("pivot").agg(F.count_if(~F.col("linked")).alias("n_apart"), F.count_if("linked").alias("n_linked")).where("n_apart > 0 and n_apart + n_linked > 1")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    grouped = members.join(counts, "pivot").withColumns({"pa": parts("n_apart"), "pl": parts("n_linked")})
    own = F.pmod(F.xxhash64("set"), F.when(F.col("linked"), F.col("pl")).otherwise(F.col("pa"))).cast("int")
    # A block pair is (i, j); j counts the blocks of those apart first, then those of the linked.
    first = F.transform(F.sequence(F.col("o"), F.col("pa") + F.col("pl") - 1), lambda j: F.struct(F.col("o").alias("i"), j.alias("j"), F.when(j == F.col("o"), F.lit(2)).otherwise(F.lit(0)).alias("side")))
    upto = F.when(F.col("o") > 0, F.sequence(F.lit(0), F.col("o") - 1)).otherwise(F.array().cast("array<int>"))
    second = F.transform(upto, lambda i: F.struct(i.alias("i"), F.col("o").alias("j"), F.lit(1).alias("side")))
    late = F.transform(F.sequence(F.lit(0), F.col("pa") - 1), lambda i: F.struct(i.alias("i"), (F.col("pa") + F.col("o")).alias("j"), F.lit(1).alias("side")))
    spread = grouped.withColumn("o", own).withColumn("to", F.explode(F.when(F.col("linked"), late).otherwise(F.concat(first, second))))
    full = spread.select("pivot", "to.i", "to.j", "to.side", "set").join(rows.select("set", "size", "rest"), "set")
    return full.groupBy("pivot", "i", "j").applyInArrow(lambda t: _products(t, percent), "a long, b long")


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, block: int = 1500) -> DataFrame:
    """doc_id, key (a hash of the text), size (of the set), component_id (the smallest id reachable by links) and component (a
    number that all linked rows have in common, null where the set is linked with no other row) of every document row.

    percent: two documents link if their sets' overlap is so many hundredths of their union at least; block: rows in a
    block of the product.
    """
    every = reduced_sets(docs, doc_id=doc_id, text=text, n=n, percent=percent)
    rows = saved(every.where("rest is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("rest").alias("rest")), "rows")
    prefix = F.size("rest") - F.ceil(F.col("size") * percent / 100).cast("int") + 1
    index = saved(rows.select("set", F.try_divide(F.size("rest"), "size").alias("share"), F.explode(F.slice("rest", 1, prefix)).alias("gram")), "index")
    # The pivot of an entry is the row that kept most of its n-grams: of near copies, the one that most others are copies of.
    pivots = index.groupBy("gram").agg(F.max(F.struct("share", "set")).alias("p"), F.count("*").alias("n")).where("n > 1").select("gram", F.col("p.set").alias("pivot"))
    met = index.join(pivots, "gram").select("pivot", "set").where("pivot <> set").distinct()
    ends = [rows.select(F.col("set").alias(x), F.col("size").alias(f"size_{x}"), F.col("rest").alias(f"rest_{x}")) for x in ("pivot", "set")]
    overlap = F.size(F.array_intersect("rest_pivot", "rest_set")).cast("long")
    whole = met.join(ends[0], "pivot").join(ends[1], "set").withColumn("overlap", overlap)
    linked = 100 * F.col("overlap") >= percent * (F.col("size_pivot") + F.col("size_set") - F.col("overlap"))
    members = saved(whole.select("pivot", "set", linked.alias("linked")), "members")
    edges = members.where("linked").select(F.col("pivot").alias("a"), F.col("set").alias("b")).unionByName(_block_edges(members, rows, percent, block))
    roots = connected(edges)
    named = rows.join(roots, rows["set"] == roots["node"], "left").select("set", F.coalesce("root", "set").alias("label"), "least")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    back = named.join(smallest, "label").select("set", "component_id", F.col("label").alias("component"))
    return every.join(back, "set", "left").select("doc_id", "key", "size", F.coalesce("component_id", "doc_id").alias("component_id"), "component")
