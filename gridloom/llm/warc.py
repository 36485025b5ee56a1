"""WARC archives with a two-level capture index.

Writing: records with equal payloads of ``DEDUP_BYTES`` or more are written once,
by the smallest page id; the others are revisits of it. Each task writes archives of gzip members, one a
record, and reports where each record stands. Index: captures sorted by
reversed-host URL key are packed into compressed blocks, and a sparse directory
holds each block's first key and place. A lookup bisects the files' first keys, then the directory of each file, reads
the block by its range, bisects its lines, and reads the record by its range. Many URLs are looked up at once: the keys
are dealt out by file, and what is found is read archive by archive in the order of offsets, neighbouring ranges as one.

Files are in the shared folder and are opened through ``pyarrow.fs``. A task that
is run again writes files of new names, and only those that a finished task has
reported are ever read, so lost executors do no harm.

A null payload counts as empty, a null url as no url with the empty key. A null
page id is written as no number, and never refers. Rows of one page id are
records of their own. Empty tables give an index without blocks.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, ready, scratch, written

DEDUP_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
#: Lines of a file of blocks, about, and files at most: the driver holds and broadcasts the files' first keys.
FILE_LINES, FILES = 16_000, 20_000
#: Pages from which on a digest can be so frequent that its first page is broadcast, and such digests at most.
HOT, HOT_DIGESTS = 1000, 10_000
#: Bytes of archives that a task reads, about.
READ_BYTES = 64 << 20
JOIN_GAP, JOIN_BYTES = 64 << 10, 4 << 20
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query, in lower-case host: ``com,example,www)/path?q``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(url, safe="")
    head = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        head += f":{port}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return head + ")" + quote(tail, safe="/?&=%:;,+@!$'()*~-._#[]")


def member(block: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(block) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Capture:
    page_id: int | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def _number(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def parse(raw: bytes) -> Capture:
    """Reads back one gzip member; a response's payload must have the digest that its head gives."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return Capture(_number(fields["WARC-Record-ID"]), fields["WARC-Type"], size, digest, _number(fields.get("WARC-Refers-To")), payload if response else None)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def with_types(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, size, digest, refers_to)``; a revisit's payload is left out."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = F.col("size") >= DEDUP_BYTES
    first = rows.where(shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "first")
    most = max(HOT, (first.agg(F.sum("n")).first()[0] or 0) // HOT_DIGESTS)
    hot = first.where(F.col("n") >= most).select("digest", F.col("first").alias("hot_first"))
    seen = rows.join(F.broadcast(hot), "digest", "left")
    # Payloads of frequent digests have what they need, so they are spread by a key of their own.
    seen = seen.withColumn("by", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    out = seen.join(first.where(F.col("n") < most).select(F.col("digest").alias("by"), "first"), "by", "left")
    one = F.coalesce("hot_first", "first")
    out = out.withColumn("refers_to", F.when(shared & (one != F.col("page_id")), one))
    return out.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


_CAPTURES = "key string, page_id long, archive string, offset long, length long"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the captures ``(key, page_id, archive, offset, length)`` as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    at += out.write(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))
                raw = member(record(r["page_id"], r["url"], r["payload"] or b"", r["digest"], r["size"], r["refers_to"]))
                out.write(raw)
                rows.append((url_key(r["url"]), r["page_id"], name, at, len(raw)))
                at += len(raw)
            yield batch_of(pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]), *zip(*rows, strict=True))
        if out is not None:
            out.close()

    return written(records.mapInArrow(run, _CAPTURES), "captures")


_BLOCKS = pa.schema([("first_key", pa.string()), ("first_page", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64()), ("bytes", pa.int64())])


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the blocks; the sparse directory as a table in the shared folder, one file of it for each file of blocks.

    Captures are dealt by ranges of key, page, archive and offset: a URL captured very often spreads over ranges.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        name, at, lines, out = f"{uuid.uuid4().hex}.cdx", 0, [], None
        blocks: list[tuple] = []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            out.write(raw)
            blocks.append((lines[0][0], lines[0][1] if lines[0][1] != "" else None, name, at, len(raw), len(lines), sum(x[4] for x in lines)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for r in batch.to_pylist():
                lines.append((r["key"], "" if r["page_id"] is None else r["page_id"], r["archive"], r["offset"], r["length"]))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            yield batch_of(_BLOCKS, *zip(*blocks, strict=True))

    order = ["key", "page_id", "archive", "offset"]
    files = min(FILES, max(1, -(-captures.count() // FILE_LINES)))
    dealt = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(pack, "first_key string, first_page long, file string, offset long, length long, lines long, bytes long"), "directory")


def read_range(store: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def block_lines(store: fs.FileSystem, folder: str, file: str, offset: int, length: int) -> list[list[str]]:
    raw = zlib.decompress(read_range(store, f"{folder}/{file}", offset, length)).decode()
    return [x.split("\t") for x in raw.split("\n")]


def _may_hold(firsts: list[str], key: str) -> range:
    """Of parts in order, given their first keys, those that may hold a key: one that is captured very often is in several."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


class CaptureIndex:
    """Archives and index of one writing."""

    def __init__(self, spark: SparkSession, archives: str, blocks: str, directory: DataFrame) -> None:
        self.spark, self.archives, self.blocks, self.directory = spark, archives, blocks, directory
        #: First key of each file of blocks, in order: ``FILES`` at most.
        self.files = sorted((tuple(r) for r in directory.groupBy("file").agg(F.min("first_key").alias("k")).select("k", "file").collect()))
        self.bytes = directory.agg(F.sum("bytes")).first()[0] or 0

    def places(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """``(key, archive, offset, length)`` of all captures of the URLs, by bisection. A null URL is that of captures without one."""
        blocks, files = self.blocks, self.spark.sparkContext.broadcast(self.files)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = [k for k, _ in files.value]
            for batch in batches:
                found = [(url_key(u), files.value[i][1]) for u in batch.column(0).to_pylist() for i in _may_hold(firsts, url_key(u))]
                yield batch_of(pa.schema([("key", pa.string()), ("file", pa.string())]), [k for k, _ in found], [f for _, f in found])

        def find(wanted: pa.Table, directory: pa.Table) -> pa.Table:
            store, path = opened(blocks)
            rows = sorted(zip(*(directory.column(c).to_pylist() for c in ("offset", "first_key", "length", "file")), strict=True))
            firsts, out = [k for _, k, _, _ in rows], []
            held, lines = -1, []
            for key in sorted(wanted.column("key").to_pylist()):
                for i in _may_hold(firsts, key):
                    if i != held:
                        held, lines = i, block_lines(store, path, rows[i][3], rows[i][0], rows[i][2])
                    at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while at < len(lines) and lines[at][0] == key:
                        out.append((key, lines[at][2], int(lines[at][3]), int(lines[at][4])))
                        at += 1
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "archive", "offset", "length"])

        keys = urls.select(F.col(f"`{url}`").cast("string").alias("url")).distinct().mapInArrow(deal, "key string, file string").distinct()
        held = self.directory.select("file", "offset", "first_key", "length")
        return keys.groupBy("file").cogroup(held.groupBy("file")).applyInArrow(find, "key string, archive string, offset long, length long")

    def read(self, places: DataFrame, payloads: bool = False) -> DataFrame:
        """The records at ``(archive, offset, length)``."""
        archives = self.archives

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = opened(archives)
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)))
            for batch in batches:
                for archive, start, ranges in _joined(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    raw = read_range(store, f"{path}/{archive}", start, ranges[-1][0] + ranges[-1][1] - start)
                    out: list[tuple] = []
                    for offset, length in ranges:
                        c = parse(raw[offset - start : offset - start + length])
                        out.append((c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to, c.payload if payloads else None))
                    yield batch_of(schema, *zip(*out, strict=True))

        # An explicit number, as the places say little about the bytes behind them.
        tasks = max(math.ceil(self.bytes / READ_BYTES), min(math.ceil(self.bytes / JOIN_BYTES), 2 * self.spark.sparkContext.defaultParallelism), 1)
        dealt = places.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / JOIN_BYTES)).sortWithinPartitions("archive", "offset")
        out = dealt.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
        return out if payloads else out.drop("payload")

    def lookup_all(self, urls: DataFrame, url: str = "url", payloads: bool = False) -> DataFrame:
        """All captures of the URLs, each once. Revisits have no payload."""
        return self.read(self.places(urls, url), payloads)

    def lookup(self, url: str | None) -> list[Capture]:
        """All captures of one URL, by page."""
        rows = self.lookup_all(self.spark.createDataFrame([(url,)], "url string"), payloads=True).collect()
        found = [Capture(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
        return sorted(found, key=lambda c: (c.page_id is None, c.page_id or 0))


def _joined(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Neighbouring ranges of an archive as one read."""
    archive, start, ranges = None, 0, []
    for name, offset, length in rows:
        if ranges and (name != archive or offset - (ranges[-1][0] + ranges[-1][1]) > JOIN_GAP or offset + length - start > JOIN_BYTES):
            yield archive, start, ranges
            ranges = []
        if not ranges:
            archive, start = name, offset
        ranges.append((offset, length))
    if ranges:
        yield archive, start, ranges


def write_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> CaptureIndex:
    """Archives and index of all pages, under ``folder`` (by default a new one in the shared folder)."""
    spark = ready(pages.sparkSession)
    folder = folder or scratch(spark, "warc")
    captures = write_archives(with_types(pages, id_col, url, html), f"{folder}/archives")
    return CaptureIndex(spark, f"{folder}/archives", f"{folder}/index", build_index(captures, f"{folder}/index"))
