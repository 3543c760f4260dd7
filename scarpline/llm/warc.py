"""WARC archives: a writer of response and revisit records, and a sequential reader.

Each record is one gzip member. The reader feeds the file piece by piece to zlib, finds the end of each member, frames the
record by its Content-Length and verifies block and payload digests; memory holds one record and one piece of the file.

``write`` deals pages over archives by Spark's partitions; each task writes its archive under a name of its attempt and
then moves it, so a repeated task leaves one whole file. Of pages with equal payloads of ``revisit_bytes`` and more, the
one with the smallest id is a response, the others are revisits without payload that name it.

Null payloads are empty ones. A null url becomes ``urn:page:<id>``; white space and control characters in urls are
percent-encoded in the record. Null ids are written as empty fields, read back as null, and come last in the choice of
the response. Rows with one id and equal payloads are all responses, if theirs is the smallest id. Empty tables leave no
archive and read back as no records. Columns other than those named are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PIECE = 1 << 16
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _fields(pairs: Iterable[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def _uri(url: str | None, page: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member with the record of a page; refers_to makes it a revisit."""
    page = "" if page_id is None else str(page_id)
    block = b"" if refers_to is not None else _HTTP % len(payload) + payload
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Page-Id", page), ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is None:
        pairs.append(("Content-Type", "application/http; msgtype=response"))
    else:
        pairs += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    pairs.append(("Content-Length", str(len(block))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_fields(pairs) + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one after the other."""
    unpacker, out, rest = zlib.decompressobj(31), [], b""
    while True:
        piece = rest or stream.read(_PIECE)
        rest = b""
        if not piece:
            if out or unpacker.unconsumed_tail:
                raise ValueError("the archive ends within a record")
            return
        out.append(unpacker.decompress(piece))
        if unpacker.eof:
            yield b"".join(out)
            rest, out, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises where framing or digests are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("wrong block digest")
    return fields, block


def _records(stream) -> Iterator[tuple]:
    for raw in members(stream):
        fields, block = parse(raw)
        digest, page, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["X-Page-Id"], fields.get("WARC-Refers-To")
        payload = None
        if fields["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != int(fields["X-Payload-Length"]) or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"wrong payload digest in page {page}")
        yield int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], payload, int(fields["X-Payload-Length"]), digest, int(refers[10:-1]) if refers else None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def planned(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str | Column = "html", revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    content = F.coalesce(F.col(payload) if isinstance(payload, str) else payload, F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), content.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= revisit_bytes
    firsts = rows.where(large).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    joined = rows.join(firsts, (F.col("digest") == F.col("_digest")) & large, "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write(plan: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> list[str]:
    """Write planned records as archives into the folder, which all executors reach; returns the archives' paths."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name, out, n = f"pages-{task.partitionId():06d}.warc.gz", None, 0
        for batch in batches:
            if len(batch) and out is None:
                store, root = _open(folder)
                store.create_dir(root, recursive=True)
                draft = f"{root}/.{name}.{task.taskAttemptId()}"
                out = store.open_output_stream(draft, compression=None)
            for p, u, b, d, r in zip(batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True):
                out.write(record(None if pd.isna(p) else int(p), u, bytes(b), d, None if pd.isna(r) else int(r), date))
                n += 1
        if out is not None:
            out.close()
            store.move(draft, f"{root}/{name}")
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    # Ids as nullable integers would become floats above 2^53; they travel as strings.
    safe = plan.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return [r["path"] for r in safe.mapInPandas(pack, "path string, records long").collect()]  # one row for each archive


def read(spark: SparkSession, paths: list[str], *, payloads: bool = True) -> DataFrame:
    """The records of the archives, one task for each archive; payload is null for revisits, or for all without ``payloads``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, size = [], 0
                    for r in _records(stream):
                        rows.append(r if payloads else (*r[:3], None, *r[4:]))
                        size += len(r[3] or b"") if payloads else 100
                        if size > 8_000_000 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInPandas(unpack, RECORDS)
