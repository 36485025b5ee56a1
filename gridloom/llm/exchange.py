"""Exchanges of hashes between chunks of documents, in packed form.

Some operators must bring every hash of every text together with equal ones from
elsewhere. As rows that would move many times the input, so documents are
written once as *chunks*, a row each of about ``CHUNK_BYTES`` of text, and each chunk sends each
*segment* of the hash space one blob: its distinct hashes in order, with what belongs to them, as
compressed planes of bytes. A segment's task merges its blobs and answers each chunk with a blob;
answers are files in the shared folder, which the task of the chunk opens in its next pass.
A hash that is everywhere is sent once by each chunk, so no segment gets more of it than there are chunks.

Everything that a later pass needs is in the shared folder, so a lost executor only costs its tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ready, scratch, utf8

CHUNK_BYTES = 6 << 20
CHUNKS_PER_FILE = 8
#: Hashes that a segment gets, about.
SEGMENT = 2 << 20


# ------------------------------------------------------------------- packing
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as planes of bytes, compressed."""
    z = zstandard.ZstdCompressor(level=1)
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        c = z.compress(planes)
        out.append(struct.pack("<BQQ", a.itemsize, len(a), len(c)) + c)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    z, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(blob):
        size, n, length = struct.unpack_from("<BQQ", blob, at)
        at += 17
        planes = np.frombuffer(z.decompress(blob[at : at + length], max_output_size=max(1, size * n)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").reshape(-1))
        at += length
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value through a mixing permutation."""
    with np.errstate(over="ignore"):
        z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


# -------------------------------------------------------------------- chunks
def stage(docs: DataFrame, id_col: str, text: str, lower: bool = False) -> DataFrame:
    """Documents as rows ``(chunk, ids, texts, words)`` in the shared folder; ``words`` counts the chunk's words.

    Null texts become empty; null ids stay null.
    """
    spark = ready(docs.sparkSession)
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        seq, size, words, ids, texts = 0, 0, 0, [], []

        def row() -> pa.RecordBatch:
            nonlocal seq, size, words, ids, texts
            out = pa.RecordBatch.from_arrays([pa.array([first + seq]), pa.array([ids], schema.field(1).type), pa.array([texts], schema.field(2).type), pa.array([words])], schema=schema)
            seq, size, words, ids, texts = seq + 1, 0, 0, [], []
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(d)
                texts.append((t.lower() if lower else t).decode())
                size += len(t)
                words += len(t.split())
                if size >= CHUNK_BYTES:
                    yield row()
        if ids:
            yield row()

    source = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"))
    path = scratch(spark, "chunks")
    made = source.mapInArrow(run, "chunk long, ids array<long>, texts array<string>, words long")
    made.write.option("maxRecordsPerFile", CHUNKS_PER_FILE).option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Chunk:
    """Words of a chunk's documents, end to end. ``of``: each word's document; ``starts``, ``ends``: by document."""

    def __init__(self, ids: list[int | None], texts: Sequence[bytes]) -> None:
        self.ids = ids
        self.words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, self.words), np.int64, len(ids))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.size = int(sizes.sum())

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for d in self.words for w in d), np.uint64, self.size)

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.ends - self.starts)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), Chunk(batch.column(1)[i].as_py(), utf8(batch.column(2)[i].values))


# ------------------------------------------------------------------ exchange
def segments(words: int) -> int:
    return max(8, -(-words // SEGMENT))


def by_segment(h: np.ndarray, count: int) -> np.ndarray:
    """Borders of the segments in an ordered array of hashes: segment s has [borders[s], borders[s+1])."""
    edges = np.array([(s << 64) // count for s in range(1, count)], np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


_BLOBS = pa.schema([("segment", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def blobs(chunk: int, count: int, h: np.ndarray, *more: np.ndarray, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """What a chunk sends: a blob for each segment. ``h`` is distinct and in order; only its top ``bits`` are sent."""
    borders = by_segment(h, count)
    key = h >> np.uint64(64 - bits)
    full = [s for s in range(count) if borders[s] < borders[s + 1]]
    packed = [pack(key[borders[s] : borders[s + 1]], *(m[borders[s] : borders[s + 1]] for m in more)) for s in full]
    if full:
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(packed, pa.binary())], schema=_BLOBS)


class Merged:
    """The blobs of a segment: columns end to end in the order of the hash, with the chunk each row came from."""

    def __init__(self, table: pa.Table) -> None:
        parts = [unpack(b) for b in table.column("blob").to_pylist()]
        self.chunks = np.array(table.column("chunk").to_pylist(), np.int64)
        sizes = [len(p[0]) for p in parts]
        self.columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        self.sent_by = np.repeat(np.arange(len(parts)), sizes)
        self.borders = np.concatenate(([0], np.cumsum(sizes)))
        self.order = np.argsort(self.columns[0], kind="stable")
        h = self.columns[0][self.order]
        self.new = np.concatenate(([True], h[1:] != h[:-1]))
        self.starts = np.flatnonzero(self.new)
        group = np.cumsum(self.new) - 1
        #: For each row as sent, the number of its group of equal hashes.
        self.group = np.empty(len(h), np.int64)
        self.group[self.order] = group

    def total(self, column: int, how: np.ufunc = np.add, dtype: type = np.int64) -> np.ndarray:
        """Of each group of equal hashes."""
        return how.reduceat(self.columns[column][self.order].astype(dtype), self.starts)

    def answers(self, values: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """For each chunk a blob of ``values``, which has one for each row sent, or those of ``rows`` (a mask) alone."""
        for i, chunk in enumerate(self.chunks.tolist()):
            part = slice(self.borders[i], self.borders[i + 1])
            v = values[part] if rows is None else values[part][rows[part]]
            if len(v):
                yield chunk, pack(v)


def exchanged(sent: DataFrame, reduce: Callable[[int, Merged], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``(segment, chunk, blob)`` from the reducer of each segment."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        rows = list(reduce(segment, Merged(table)))
        return pa.table([pa.array([segment] * len(rows), pa.int32()), pa.array([c for c, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], schema=_BLOBS)

    return sent.groupBy("segment").applyInArrow(run, "segment int, chunk long, blob binary")


class Answers:
    """Answers to chunks, one folder for the chunks of each file of chunks."""

    def __init__(self, answers: DataFrame, name: str) -> None:
        self.path = scratch(answers.sparkSession, name)
        bucket = F.shiftright("chunk", 3).alias("bucket")
        assert CHUNKS_PER_FILE == 8
        answers.select("segment", "chunk", "blob", bucket).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def reader(self) -> Callable[[int], list[list[np.ndarray]]]:
        """A function, for use in a task, that gives a chunk's answers in the order of segments."""
        store, folder = fs.FileSystem.from_uri(self.path)
        held: dict[int, dict[int, list[tuple[int, bytes]]]] = {}

        def read(chunk: int) -> list[list[np.ndarray]]:
            bucket = chunk >> 3
            if bucket not in held:
                held.clear()
                rows: dict[int, list[tuple[int, bytes]]] = {}
                for info in store.get_file_info(fs.FileSelector(f"{folder}/bucket={bucket}", allow_not_found=True)):
                    if info.base_name.endswith(".parquet"):
                        with store.open_input_file(info.path) as f:
                            t = pq.ParquetFile(f).read(columns=["segment", "chunk", "blob"])
                        for s, c, b in zip(*(t.column(k).to_pylist() for k in ("segment", "chunk", "blob")), strict=True):
                            rows.setdefault(c, []).append((s, b))
                held[bucket] = rows
            return [unpack(b) for _, b in sorted(held[bucket].get(chunk, []))]

        return read


def part(reader: Callable[[int], list[list[np.ndarray]]], chunk: int, column: int, dtype: type) -> np.ndarray:
    """One column of a chunk's answers, end to end."""
    got = [a[column] for a in reader(chunk)]
    return np.concatenate(got).astype(dtype) if got else np.zeros(0, dtype)
