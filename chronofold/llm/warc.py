"""WARC archives, index first.

Each writing task appends gzip-member records to an archive of its own in the shared folder and returns one index row
per record: file, offset, length, URL, digest.  File names carry the attempt, and only index rows of committed tasks
name a file, so a lost or repeated task leaves nothing that a reader sees.  A reader sorts the index rows of each
archive, joins near byte ranges into one read, and parses the records in it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Tables, hadoop, new_path

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(url: str | None) -> str:
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


#: What a response has before its payload: the digest is that of the payload alone.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for equal rows on every run, so a revisit can name its response without reading it."""
    return f"urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}"


def _lines(kind: str, identity: str, more: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The first record of an archive."""
    return _lines("warcinfo", record_id(None, name), [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; size and digest describe the full payload."""
    again = refers_to is not None
    more = [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    more += [f"WARC-Target-URI: {_clean(url)}"] * (url is not None) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    more += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"] if again else []
    return _lines("revisit" if again else "response", record_id(page_id, digest), more, b"" if again else HTTP_HEAD + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, at, out, fs = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, None, None
        for batch in batches:
            rows = []
            for page, url, html, n, digest, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "n", "digest", "refers_to"))):
                if out is None:
                    fs, path = _fs(folder)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    at += out.write(_member(warcinfo(name), level))
                data = _member(record(page, url, html, n, digest, refers), level)
                out.write(data)
                rows.append((name, at, len(data), page, url, digest, "response" if refers is None else "revisit"))
                at += len(data)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    return run


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined where the gap is small and the read stays below `most` bytes."""
    start = end = None
    inside: list[tuple[int, int]] = []
    for at, n in ranges:
        if inside and (at - end > gap or at + n - start > most):
            yield start, end, inside
            inside = []
        if not inside:
            start = end = at
        inside.append((at, n))
        end = max(end, at + n)
    if inside:
        yield start, end, inside


def _reader(folder: str, gap: int, most: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        name, file = None, None
        for batch in batches:
            files, offs, lens = (batch[c].to_pylist() for c in ("file", "offset", "length"))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != name:
                    if file is not None:
                        file.close()
                    name, file = files[i], fs.open_input_file(f"{path}/{files[i]}")
                for start, end, inside in coalesced(list(zip(offs[i:j], lens[i:j])), gap, most):
                    data = file.read_at(end - start, start)
                    yield _records([data[at - start : at - start + n] for at, n in inside], payloads)
                i = j
        if file is not None:
            file.close()

    return run


def _records(members: list[bytes], payloads: bool) -> pa.RecordBatch:
    rows = []
    for member in members:
        head, block = parse(zlib.decompress(member, 31))
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        kind, refers = head["WARC-Type"], head.get("X-Refers-To-Page-ID")
        block = block.partition(b"\r\n\r\n")[2]
        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
            raise ValueError("a payload does not have the digest of its record")
        page = head.get("X-Page-ID")
        size = len(block) if kind == "response" else int(head["X-Payload-Length"])
        rows.append((page and int(page), head.get("WARC-Target-URI"), kind, refers and int(refers), size, digest, block if payloads and kind == "response" else None))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def write_warc(pages: DataFrame, least: int = 100, level: int = 1) -> tuple[str, DataFrame]:
    """Write one record per row of (page_id, url, html); the archives' folder and their index.

    Of equal payloads of at least `least` bytes the smallest page_id is the response and the others revisit it; rows
    that repeat that page_id are responses too, and so are all rows of a payload that has null page_ids only.  A null
    html is an empty payload, a null url writes no target, an empty table writes no archive; equal rows have equal record ids.  Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    fs, p = hadoop(spark, folder)
    fs.mkdirs(p)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("n"), F.sha2("html", 256).alias("digest"))
    # only ids and digests meet by digest; bodies are joined by row, so copies of one page spread over all tasks
    ids = base.where(F.col("n") >= least).groupBy("page_id", "digest").agg(F.count("*").alias("rows"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("rows").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    again = ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    joined = base.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    html = F.when(F.col("first").isNotNull(), F.lit("")).otherwise(F.col("html")).cast("binary").alias("html")
    rows = joined.select("page_id", "url", html, "n", "digest", F.col("first").alias("refers_to"))
    index = Tables(spark).write(rows.mapInArrow(_writer(folder, level), INDEX), "warc-index")
    return folder, index


def read_warc(spark: SparkSession, folder: str, index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records that index rows select, by coalesced byte-range reads; digests of read payloads are checked."""
    files = max(1, index.select("file").distinct().count())
    rows = index.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, gap, most, payloads), RECORD)
