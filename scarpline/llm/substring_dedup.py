"""Removal of passages that an earlier document has, by suffix automata of shards of reference passages.

Streaming every document against the automata of all shards of a corpus, broadcast one after the other, takes time that
grows with the square of the corpus. So passages are first sent where they can match:

1. Every window of ``least`` words has an anchor, the k-gram in it of the smallest hash; equal windows have equal anchors.
   Anchors (a fifth of all places) are counted by blocks of documents and ranges of hashes; those that only one document
   has are dropped. ``anchors`` returns the others to their documents.
2. Documents with anchors send the words of the windows that have an anchor to the anchor's shard.
3. In a shard, documents stream by id: matching statistics against the suffix automaton of the passages of smaller ids
   give the maximal spans of ``least`` words and more; then the document's own passages join the automaton.
4. Spans return to their documents, and the words in them go.

An anchor that more than ``hot`` places share (a license line, a menu) would be one large shard. Hot anchors that stand
together make a region, which is sent once, by a 128-bit hash of its words: of equal regions all but the one of the
smallest id go. The windows of those, and the windows that overlap a region's ends, are sent one by one. Smallest ids are
aggregates with partial sums, and joins on them can be split, so no task gets all rows of a hot region.

Null texts have no words. A document without id is never earlier than another, and has no earlier ones: it is left
whole. Rows with one id don't affect each other; repeated rows give equal results. Texts may have any length. Empty
tables give empty tables. Columns other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton, spans
from .common import gram_hashes, rows_per_batch, saved, scratch, slices, word_hashes
from .jaccard_join import SEVERAL, runs


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, as texts and anchors take several times their room as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone


def anchors_of(texts: pa.Array, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all texts: the text's number, the place in its words, the hash, and the windows that have it: 256 times
    the words from the first window's start to the place, plus their number."""
    words, begins = word_hashes(texts)
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words[:0], np.zeros(0, np.uint16)
    grams = gram_hashes(words, k)
    at = np.lib.stride_tricks.sliding_window_view(grams, least - k + 1).argmin(1) + np.arange(len(words) - least + 1)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    window = np.flatnonzero(owner[: len(at)] == owner[least - 1 :])  # those within one text
    at = at[window]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
    count, at, start = np.diff(np.append(first, len(at))), at[first], window[first]
    return owner[at], at - begins[owner[at]], grams[at], ((at - start) * 256 + count).astype(np.uint16)


_NAMES = ["batch", "range", "docs", "texts", "idx", "hash", "at", "span", "count"]
_KINDS = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
_BLOCK = "batch long, range int, docs array<long>, texts array<long>, idx binary, hash binary, at binary, span binary, count binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _blocks(docs: DataFrame, least: int, k: int, ranges: int, block: int) -> DataFrame:
    """Anchors in blocks of documents, each cut into ranges of hashes: those of one document with their places, one that several
    documents have once, with the number of places. The documents, and the places of what they share, are one row more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        texts: list = []
        found: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            owner, at, every, span = (np.concatenate([f[i] for f in found]) for i in range(4))
            found.clear()
            order = np.argsort(every, kind="stable")  # places of one hash stay in the order of documents
            owner, at, every, span = owner[order].astype(np.uint16), at[order].astype(np.uint32), every[order], span[order]
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else order
            ends = np.append(starts[1:], len(every)).astype(np.int64)[: len(starts)]
            many = owner[starts] != owner[ends - 1]
            within = np.repeat(many, ends - starts)
            yield _batch([(number, number % ranges, list(ids), list(texts), owner[within].tobytes(), every[within].tobytes(), at[within].tobytes(), span[within].tobytes(), None)])
            heads = np.zeros(len(every), bool)
            heads[starts[many]] = True
            count = np.zeros(len(every), np.uint32)
            count[starts] = ends - starts
            owner = np.where(heads, np.uint16(SEVERAL), owner)
            sent = ~within | heads
            owner, at, every, span, count = owner[sent], at[sent], every[sent], span[sent], count[sent]
            place = ((every >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # ascends, as the hashes do
            rows = []
            for r, part in runs(place):
                o = owner[part]
                rows.append((number, r, None, None, o.tobytes(), every[part].tobytes(), at[part][o != SEVERAL].tobytes(), span[part][o != SEVERAL].tobytes(), count[part][o == SEVERAL].tobytes()))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in slices(batches):
            if len(ids) + batch.num_rows >= SEVERAL:
                yield from flush()
                ids, texts, total, number = [], [], 0, number + 1
            owner, *more = anchors_of(batch.column(2), least, k)
            found.append((owner + len(ids), *more))
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            total += len(owner)
            if total >= block:
                yield from flush()
                ids, texts, total, number = [], [], 0, number + 1
        if ids:
            yield from flush()

    return docs.select("doc_id", "key", "text").mapInArrow(run, _BLOCK)


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one range, which stand together: anchors of one document alone go, those of more than ``hot`` places are marked."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(r[5], np.uint64) for r in rows]
        every, owner = np.concatenate(hashes), np.concatenate([np.frombuffer(r[4], np.uint16) for r in rows])
        several = owner == SEVERAL
        count = np.ones(len(every), np.int64)
        count[several] = np.concatenate([np.frombuffer(r[8], np.uint32) for r in rows])
        owner = owner + (np.repeat(np.arange(len(rows)), [len(h) for h in hashes]) << 16)
        order = np.argsort(every, kind="stable")
        ordered, owners = every[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        lengths = np.diff(np.append(starts, len(ordered)))
        many = (np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)) | np.logical_or.reduceat(several[order], starts)
        kept, marked = np.empty(len(every), bool), np.empty(len(every), np.uint8)
        kept[order] = np.repeat(many, lengths)
        marked[order] = np.repeat(np.add.reduceat(count[order], starts) > hot, lengths)
        at, out = 0, []
        for r, h in zip(rows, hashes, strict=True):
            mine, hots, alone = kept[at : at + len(h)], marked[at : at + len(h)], ~several[at : at + len(h)]
            at += len(h)
            if mine.any():
                places, span = np.frombuffer(r[6], np.uint32)[mine[alone]], np.frombuffer(r[7], np.uint16)[mine[alone]]
                out.append((r[0], r[1], None, None, np.frombuffer(r[4], np.uint16)[mine].tobytes(), h[mine].tobytes(), places.tobytes(), span.tobytes(), hots[mine].tobytes()))
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


_ANCHORS = "doc_id long, key long, at array<int>, span array<int>, hash array<long>, hot array<boolean>"


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one block, which stand together, with their anchors."""

    def flush(docs: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        kinds = ((4, np.uint16), (5, np.uint64), (6, np.uint32), (7, np.uint16), (8, np.uint8))
        idx, hashes, at, span, hot = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in kinds)
        several = idx == SEVERAL
        # Anchors of several documents of the block: the row of documents has their places.
        known, inside = np.sort(hashes[several]), np.frombuffer(docs[5], np.uint64)
        hots = hot[several][np.argsort(hashes[several])][np.searchsorted(known, inside)]
        idx, hashes, hot = np.append(idx[~several], np.frombuffer(docs[4], np.uint16)), np.append(hashes[~several], inside), np.append(hot[~several], hots)
        at, span = np.append(at, np.frombuffer(docs[6], np.uint32)), np.append(span, np.frombuffer(docs[7], np.uint16))
        order = np.lexsort((at, idx))
        idx, hashes, at, span, hot = idx[order], hashes[order].view(np.int64), at[order].astype(np.int32), span[order].astype(np.int32), hot[order].astype(bool)
        some, starts = np.unique(idx, return_index=True)
        offsets = pa.array(np.append(starts, len(idx)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, span, hashes, hot)]
        yield pa.RecordBatch.from_arrays([pa.array([docs[2][i] for i in some], pa.int64()), pa.array([docs[3][i] for i in some], pa.int64()), *lists], [c.split()[0] for c in _ANCHORS.split(", ")])

    docs, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] is not None:  # comes first of its block
                if docs is not None:
                    yield from flush(docs, held)
                docs, held = row, []
            else:
                held.append(row)
    if docs is not None:
        yield from flush(docs, held)


def anchors(docs: DataFrame, least: int, k: int, hot: int, *, block: int = 500_000, range_bytes: int = 30_000_000, tasks: int = 20_000) -> DataFrame:
    """doc_id, key and the anchors that other documents have too: at, span, hash, hot. docs: doc_id, key (of the text), text.

    A range holds the anchors of ``range_bytes`` of text; beyond ``tasks`` ranges a task counts several, one after the other.
    """
    spark = docs.sparkSession
    amount = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-amount // range_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with rows_per_batch(spark, 48):
        blocks = _blocks(docs, least, k, ranges, block)
        found = blocks.repartitionById(min(ranges, tasks), F.col("range") % min(ranges, tasks)).sortWithinPartitions("range").mapInArrow(lambda b: _shared(b, hot), _BLOCK)
        back = found.repartition(parts, "batch").sortWithinPartitions("batch", F.col("docs").isNull())
        return saved(back.mapInArrow(_returned, _ANCHORS), "anchors")


def with_anchors(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 13, k: int = 6, hot: int = 2000) -> DataFrame:
    """doc_id, key (a hash of the text), text of every row, and the anchors that other documents have too (null if none).

    A table of files in the shared scratch folder, in buckets by doc_id and key, so that what is found for a document is
    joined to its text without moving the text again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).cast("string").alias("text"))
    found = anchors(rows.where("doc_id is not null"), least, k, hot)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "doc_id", "key").dropDuplicates(["doc_id", "key"])
    joined = rows.repartition(parts, "doc_id", "key").join(found, ["doc_id", "key"], "left")
    name = f"anchored_{uuid.uuid4().hex}"
    joined.write.bucketBy(parts, "doc_id", "key").option("path", scratch(spark, "anchored")).format("parquet").saveAsTable(name)
    return spark.table(name)


#: kind: 0 a passage around an anchor, 1 what lies between the hot anchors of a region, 2 a window at a region's ends.
_PASSAGE = "shard binary, doc_id long, key long, start int, size int, words binary, kind int"
_PASSAGE_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]


class _Rows:
    """Rows of _PASSAGE that are put out some thousand at a time."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in _PASSAGE_KINDS]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, _PASSAGE_KINDS, strict=True)], [x.split()[0] for x in _PASSAGE.split(", ")])
        self.__init__()
        return out


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _passages(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """What documents send for anchors that aren't hot: the words of the windows that have the anchor."""
    rows = _Rows()
    for batch in _small(batches):
        for doc, key, text, places, windows, hashes, hots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _words(text)
            for at, span, h, hot in zip(places, windows, hashes, hots, strict=True):
                if not hot:
                    first = at - (span >> 8)
                    end = first + (span & 255) - 1 + least
                    rows.add(h.to_bytes(8, "little", signed=True), doc, key, first, end - first, b" ".join(words[first:end]), 0)
            if len(rows.columns[0]) > 20_000:
                yield rows.batch()
    if rows.columns[0]:
        yield rows.batch()


def _hot_regions(batches: Iterator[pa.RecordBatch], least: int, k: int) -> Iterator[pa.RecordBatch]:
    """What documents send for hot anchors: of those that stand together, the region between them and the windows at its ends."""
    rows = _Rows()
    for batch in _small(batches):
        for doc, key, text, places, windows, _, hots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _words(text)
            regions: list[list[int]] = []  # first and last anchor, first and last window
            for at, span, hot in zip(places, windows, hots, strict=True):
                start = at - (span >> 8)
                last = start + (span & 255) - 1
                if not hot:
                    continue
                if regions and at - regions[-1][1] <= least - k + 1:
                    regions[-1][1], regions[-1][3] = at, last
                else:
                    regions.append([at, at, start, last])
            for begin, final, start, last in regions:
                end = final + k
                inside = range(begin, end - least + 1)  # windows that the region holds whole
                if inside:
                    rows.add(_key(words[begin:end]), doc, key, begin, end - begin, b" ".join(words[begin:end]), 1)
                for s in range(start, last + 1):
                    if s not in inside:
                        rows.add(_key(words[s : s + least]), doc, key, s, least, None, 2)
            if len(rows.columns[0]) > 20_000:
                yield rows.batch()
    if rows.columns[0]:
        yield rows.batch()


def _region_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The windows of regions: columns doc_id, key, start, words."""
    rows = _Rows()
    for batch in batches:
        for doc, key, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = raw.split(b" ")
            for s in range(len(words) - least + 1):
                rows.add(_key(words[s : s + least]), doc, key, start + s, least, None, 2)
            if len(rows.columns[0]) > 20_000:
                yield rows.batch()
    if rows.columns[0]:
        yield rows.batch()


_SPAN = "doc_id long, key long, first int, end int"


def _matched(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Passages sorted by shard and document: the spans that earlier documents of the shard have."""
    shard, doc = None, None
    automaton: SuffixAutomaton | None = None
    seen: set[bytes] = set()  # passages of earlier documents, so that none joins the automaton twice
    waiting: list[bytes] = []  # those that the automaton does not have yet
    own: set[bytes] = set()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, doc_id, text, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != shard:
                shard, doc, automaton, seen, waiting, own = key, doc_id, None, set(), [], set()
            elif doc_id != doc:
                waiting += own.difference(seen)
                seen |= own
                doc, own = doc_id, set()
            own.add(raw)
            if automaton is None and not waiting:
                continue
            automaton = automaton or SuffixAutomaton()
            for w in waiting:
                automaton.add(w.split(b" "))
            waiting = []
            found = spans(automaton.statistics(raw.split(b" ")), least)
            for first, end in found:
                for column, value in zip(out, (doc_id, text, start + first, start + end), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc_id", "key", "first", "end"])


def removed_spans(rows: DataFrame, *, least: int = 13, k: int = 6) -> DataFrame:
    """doc_id, key and spans (first word, end) that smaller ids have, for documents that have any. rows: those of ``with_anchors``."""
    sent = rows.where("at is not null").select("doc_id", "key", "text", "at", "span", "hash", "hot")
    cold = sent.mapInArrow(lambda b: _passages(b, least, k), _PASSAGE).select("shard", "doc_id", "key", "start", "words")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = cold.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(lambda b: _matched(b, least), _SPAN)
    # Equal regions: all but the first go as wholes. The windows of first ones, and those at the ends, are compared one by one.
    hot = saved(sent.where(F.array_contains("hot", True)).mapInArrow(lambda b: _hot_regions(b, least, k), _PASSAGE), "regions")
    regions = _with_first(hot.where("kind = 1"))
    heads = regions.where("doc_id = least").select("doc_id", "key", "start", "words")
    windows = hot.where("kind = 2").unionByName(heads.mapInArrow(lambda b: _region_windows(b, least), _PASSAGE))
    later = regions.unionByName(_with_first(windows)).where("doc_id > least").select("doc_id", "key", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("end"))
    return streamed.unionByName(later).groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _with_first(rows: DataFrame) -> DataFrame:
    """Rows with ``least``, the smallest id that has the same words."""
    return rows.join(rows.groupBy("shard").agg(F.min("doc_id").alias("least")), "shard")


_KEPT = "doc_id long, n_words long, n_removed long, kept binary"


def _kept(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        out: list[list] = [[], [], [], []]
        for doc, text, firsts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _words(text)
            n, removed = len(words), 0
            if firsts:
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, firsts, 1)
                np.add.at(gone, ends, -1)
                keep = np.cumsum(gone[:n]) == 0
                words = [words[i] for i in np.flatnonzero(keep)]
                removed = n - len(words)
            kept = b" ".join(words)
            for column, value in zip(out, (doc, n, removed, hashlib.sha256(kept).hexdigest().encode() if digest else kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


def without_spans(rows: DataFrame, found: DataFrame, *, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces; with ``digest`` their SHA-256) of every document row."""
    spanned = rows.select("doc_id", "key", "text").join(found.hint("shuffle_hash"), ["doc_id", "key"], "left")
    spanned = spanned.select("doc_id", "text", F.col("spans.first").alias("firsts"), F.col("spans.end").alias("ends"))
    return spanned.mapInArrow(lambda b: _kept(b, digest), _KEPT).withColumn("kept", F.col("kept").cast("string"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 13, k: int = 6, hot: int = 2000, digest: bool = False) -> DataFrame:
    """Every document row without the words that windows of ``least`` words of smaller ids cover; columns as in ``without_spans``."""
    rows = with_anchors(docs, doc_id=doc_id, text=text, least=least, k=k, hot=hot)
    return without_spans(rows, saved(removed_spans(rows, least=least, k=k), "spans"), digest=digest)
