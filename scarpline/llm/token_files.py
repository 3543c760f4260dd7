"""Token ids of a corpus in files of rANS-coded blocks.

``encode_corpus`` tokenizes whole texts, appends an end id to each, counts ids over the corpus for one shared frequency
table, and writes the ids in ascending order of document id: range partitions are shards, each a run of blocks that are
coded independently (see ``rans``). A file set is a folder with

* ``blocks``: Parquet, one row for each block: shard, block, n_tokens, payload, and the pieces of documents in it (id,
  the document's number in its shard, the piece's number in the document, length). Spark's committer writes it, so lost
  executors and repeated tasks leave no half-written files, on any store that Spark reaches;
* ``frequencies``: Parquet, symbol and frequency, at most as many rows as the vocabulary.

``decode_pieces`` reads blocks in parallel and verifies checksums; ``documents`` puts lengths, starts and checksums of
whole documents together.

Null and empty texts have only the end id. Null ids sort first. Rows with one id stand side by side, ordered by a hash
of their ids of tokens, each a document of its own. Empty tables give no blocks. Texts may have any length: blocks cut
them. Columns other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import rans
from .common import rows_per_batch, saved, slices, trimmed

#: ASCII marks; behind letters they are tokens of their own. The apostrophe is not one of them, as it can begin one together with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that NFC leaves as they are and that have one letter in lower case each: of ASCII, Latin-1 and Latin Extended-A, but for U+0130.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at the starts, one after the other."""
    if not len(sizes):
        return flat[:0]
    ends = np.cumsum(sizes)
    kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(ends[-1], dtype=kind)
    return flat[at]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class WordTokenizer:
    """Ids of texts from a tokenizer that drops white space and splits at it, so that each different word of a batch is encoded once.

    Words of letters with marks behind them are encoded in two parts, the letters in lower case by the same model without the
    steps that only change other text. Whether the tokenizer is such a one is tried on a probe; if not, whole texts are
    encoded. Nothing is kept from batch to batch.
    """

    PROBE = "It's 3 o'clock,\n\n THE  end... <|endoftext|> café, Naïve x 中文 a-b_c cafe\u0301, \u0130-"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # whether a word ends with the id
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.mark = self._ids(["\x01"])
        self.by_word = bool(suffix) and len(self.mark) == 1
        if self.by_word:
            try:
                self.by_word = np.array_equal(self.encode(pa.array([self.PROBE]))[0], self._ids([self.PROBE]))
            except ValueError:  # words can't be told apart: not such a tokenizer
                self.by_word = False

    def _ids(self, texts: list[str], tokenizer=None) -> np.ndarray:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, self.kind) for e in found] or [np.zeros(0, self.kind)])

    @staticmethod
    def _joined(words: pa.Array, by: str, size: int = 500) -> list[str]:
        """Words in texts of some hundred, without a Python object for each."""
        cuts = np.append(np.arange(0, len(words), size), len(words)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), by).to_pylist()

    def _parts(self, letters: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words after each other, and how many each has."""
        easy = self._ids(self._joined(letters, " "), self.plain)
        sizes = np.diff(np.append(-1, np.flatnonzero(self.ends[easy])))
        odd = np.array(pc.match_substring_regex(others, "\x01|<\\|"), bool)  # marks themselves, and perhaps special tokens
        marked = self._ids([" \x01 ".join(["", *others.filter(pa.array(~odd)).slice(i, 500).to_pylist(), ""]) for i in range(0, int((~odd).sum()), 500)])
        at = np.flatnonzero(marked == self.mark[0])
        # Each text of 500 words begins with a mark and ends with one.
        inner = np.diff(at) - 1
        first = np.cumsum([min(500, int((~odd).sum()) - i) + 1 for i in range(0, int((~odd).sum()), 500)]) - 1
        inner = np.delete(inner, first[:-1]) if len(first) > 1 else inner
        whole = [self._ids([w]) for w in others.filter(pa.array(odd)).to_pylist()]
        if len(sizes) != len(letters) or len(inner) != int((~odd).sum()):
            raise ValueError("words can't be told apart by their ids")
        count = np.empty(len(others), np.int64)
        count[~odd], count[odd] = inner, [len(w) for w in whole]
        kept = np.concatenate([marked[marked != self.mark[0]], *whole])
        # The others are put back in their order.
        place = np.empty(len(others), np.int64)
        place[~odd], place[odd] = _starts(inner), int(inner.sum()) + _starts(count[odd])
        return np.concatenate([easy, _gathered(kept, place, count)]), np.concatenate([sizes, count])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and how many each has; ``end`` is an id behind each text."""
        tail = np.array([] if end is None else [end], self.kind)
        if not self.by_word:
            found = [np.append(self._ids([t]), tail) for t in texts.to_pylist()]
            return np.concatenate(found or [tail[:0]]), np.array([len(f) for f in found], np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        known = words.flatten().dictionary_encode()
        every = known.dictionary
        stems = pc.ascii_rtrim(every, _MARKS)
        plain = np.array(pc.match_substring_regex(stems, _LETTERS), bool)
        letters = pc.utf8_lower(stems.filter(pa.array(plain))).dictionary_encode()
        marks = _suffixes(every.filter(pa.array(plain)), stems.filter(pa.array(plain))).dictionary_encode()
        others = pa.concat_arrays([every.filter(pa.array(~plain)), marks.dictionary])
        flat, sizes = self._parts(letters.dictionary, others)
        starts, n, hard = _starts(sizes), len(letters.dictionary), int((~plain).sum())
        # Two parts for each word; the second one of words that are encoded as wholes is empty.
        part = np.full((len(every), 2), -1)
        part[plain, 0], part[plain, 1] = letters.indices.to_numpy(), marks.indices.to_numpy() + n + hard
        part[~plain, 0] = np.arange(hard) + n
        flat, starts, sizes = np.append(flat, tail), np.append(starts, [len(flat), 0]), np.append(sizes, [len(tail), 0])
        word_ids = _gathered(flat, starts[part.ravel()], sizes[part.ravel()])
        word_sizes = sizes[part].sum(1)
        # And the end is one more word behind each text's.
        flat, word_sizes = np.append(word_ids, tail), np.append(word_sizes, len(tail))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        sequence = np.insert(known.indices.to_numpy(), offsets[1:], len(every))
        counts = word_sizes[sequence]
        total = np.append(0, np.cumsum(counts))[offsets + np.arange(len(offsets))]
        return _gathered(flat, _starts(word_sizes)[sequence], counts), np.diff(total)


def _suffixes(whole: pa.Array, stems: pa.Array) -> pa.Array:
    """What each string has behind its stem."""
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    size = pc.binary_length(stems).to_numpy(False).astype(np.int64)
    sizes = np.diff(at) - size
    raw = _gathered(np.frombuffer(data or b"", np.uint8), at[:-1] + size, sizes)
    return pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(raw)])


#: Rows that are handed to Python at a time.
DOCUMENTS_PER_BATCH = 1000

_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, ids (binary, little-endian numbers of the vocabulary's width), n_tokens; tokenizer: a file's path, there on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        width = np.dtype(t.kind).itemsize
        for batch in slices(batches, batch_bytes):
            ids, sizes = t.encode(pc.fill_null(batch.column(1), ""), end_id)
            offsets = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, ids binary, n_tokens long")


def _symbol_counts(tokens: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), b"")
            n = np.bincount(np.frombuffer(whole[0].as_buffer(), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["symbol", "n"])

    return tokens.select("ids").mapInArrow(trimmed(run), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


BLOCKS = "shard int, block int, n_tokens long, piece_doc array<long>, piece_row array<long>, piece_no array<long>, piece_len array<long>, payload binary"


def _block_rows(batches: Iterator[pa.RecordBatch], kind: str, t: rans.Tables) -> Iterator[pa.RecordBatch]:
    shard, block, row = TaskContext.get().partitionId(), 0, 0
    held: list[np.ndarray] = []
    pieces: deque[list] = deque()  # id, row, number of the next piece, symbols not yet written
    n = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal block, held, n
        whole = np.concatenate(held)
        size = n if last else n - n % rans.BLOCK
        coded = rans.encode(whole[:size], t)
        rows = []
        for i, payload in enumerate(coded):
            room = min(rans.BLOCK, size - i * rans.BLOCK)
            count, parts = room, ([], [], [], [])
            while room:
                p = pieces[0]
                take = min(room, p[3])
                for column, value in zip(parts, (p[0], p[1], p[2], take), strict=True):
                    column.append(value)
                p[2], p[3], room = p[2] + 1, p[3] - take, room - take
                if not p[3]:
                    pieces.popleft()
            rows.append((shard, block, count, *parts, payload))
            block += 1
        held, n = ([whole[size:]] if size < n else []), n - size
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = np.frombuffer(ids.as_buffer(), kind)
            held.append(found)
            pieces.append([doc, row, 0, len(found)])
            row, n = row + 1, n + len(found)
            if n >= 64 * rans.BLOCK:
                yield from flush(False)
    if n:
        yield from flush(True)


def encode_corpus(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = 8_000_000) -> None:
    """Write the file set; shard_tokens: about how many ids a shard holds."""
    spark = docs.sparkSession
    kind = _tokenizer(tokenizer).kind
    with rows_per_batch(spark, DOCUMENTS_PER_BATCH):
        tokens = saved(tokenize(docs, tokenizer, end_id, doc_id=doc_id, text=text), "tokens")
        counted = _symbol_counts(tokens, kind).collect()  # at most as many rows as the vocabulary
    counts = np.zeros(max((r["symbol"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["symbol"]] = r["n"]
    freq = rans.quantised(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "symbol long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    shards = max(1, -(-int(counts.sum()) // shard_tokens))
    shared = spark.sparkContext.broadcast(freq)  # 4 bytes for each symbol of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_rows(batches, kind, rans.Tables(shared.value))

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    with rows_per_batch(spark, DOCUMENTS_PER_BATCH):
        dealt.select("doc_id", "ids").mapInArrow(trimmed(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


PIECES = "shard int, block int, doc_id long, row long, piece long, n long, crc long"


def decode_pieces(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """The pieces of documents in each block, decoded and verified; with_ids adds them as little-endian 32-bit numbers."""
    rows = spark.read.parquet(f"{folder}/frequencies").collect()  # at most as many rows as the vocabulary
    freq = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.uint32)
    for r in rows:
        freq[r["symbol"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = rans.Tables(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                columns = some.to_pydict()
                out: list[list] = [[] for _ in range(8 if with_ids else 7)]
                for k, ids in enumerate(rans.decode(columns["payload"], t)):
                    raw, place = ids.astype("<u4").tobytes(), 0
                    for doc, row, piece, n in zip(*(columns[f"piece_{c}"][k] for c in ("doc", "row", "no", "len")), strict=True):
                        mine = raw[4 * place : 4 * (place + n)]
                        place += n
                        for column, value in zip(out, (columns["shard"][k], columns["block"][k], doc, row, piece, n, zlib.crc32(mine), mine), strict=False):
                            column.append(value)
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=False)], names)

    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    schema = PIECES + (", ids binary" if with_ids else "")
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "piece_doc", "piece_row", "piece_no", "piece_len", "payload")
    return blocks.mapInArrow(trimmed(run), schema)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@cache
def _zeros(k: int) -> list[int]:
    """The matrix that appends 2 ** k zero bits to what a crc32 stands for."""
    if k == 0:
        return [0xEDB88320] + [1 << i for i in range(31)]
    half = _zeros(k - 1)
    return [_times(half, row) for row in half]


def crc32_joined(first: int, second: int, size: int) -> int:
    """The crc32 of two byte strings after each other, from theirs; size: bytes of the second."""
    for k in range(size.bit_length()):
        if size >> k & 1:
            first = _times(_zeros(k + 3), first)
    return first ^ second


@F.pandas_udf(LongType())
def _joined(counts: pd.Series, crcs: pd.Series) -> pd.Series:
    out = []
    for sizes, values in zip(counts, crcs, strict=True):
        crc = int(values[0])
        for n, v in zip(sizes[1:], values[1:], strict=True):
            crc = crc32_joined(crc, int(v), 4 * int(n))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the decoded blocks."""
    pieces = decode_pieces(spark, folder)
    whole = pieces.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("p"))
    with rows_per_batch(spark, 64):  # blocks
        whole = saved(whole, "pieces")
    columns = ["shard", "row", "doc_id", "n_tokens"]
    cut = whole.where(F.size("p") > 1).select(*columns, _joined("p.n", "p.crc").alias("ids_crc32"))  # few: those that cross a block's end
    whole = whole.where(F.size("p") == 1).select(*columns, F.element_at("p.crc", 1).alias("ids_crc32")).unionByName(cut)
    # Starts: sums within slices of a shard's documents, of slices within shards, of shards.
    sliced = whole.withColumn("slice", F.floor(F.col("row") / 1024))
    before = lambda *by: (Window.partitionBy(*by[:-1]) if by[:-1] else Window.partitionBy(F.lit(0))).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("shard", "slice").agg(F.sum("n_tokens").alias("n"))
    shards = slices.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("shard_start"))
    slices = slices.select("shard", "slice", F.coalesce(F.sum("n").over(before("shard", "slice")), F.lit(0)).alias("slice_start"))
    inner = F.coalesce(F.sum("n_tokens").over(before("shard", "slice", "row")), F.lit(0))
    rows = sliced.withColumn("inner", inner).join(slices, ["shard", "slice"]).join(F.broadcast(shards), "shard")
    return rows.select("doc_id", (F.col("shard_start") + F.col("slice_start") + F.col("inner")).cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
