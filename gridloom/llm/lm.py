"""Bigram scores from a log-frequency Bloom filter.

Counts are taken over all training documents. Unigram counts stay exact: each chunk asks for those of its own words, by their
64-bit hashes. Bigram counts are quantised on a logarithmic scale, and an n-gram of level q is put into a Bloom filter
q times, with the levels 1 to q. A count is read back by probing level after level until one
is missing. The score is Dirichlet-smoothed: (c(v,w) + K p(w)) / (c(v) + K), with p the add-half unigram probability.
A count read back is the middle of its level, at most a quarter off, so after any v the probabilities of all words and the end sum to between 0.75 and 1.25
(with exact counts to 1); a false positive adds one level, with a chance of about 0.01.

Every bigram is in the filter. It is built in segments of the hash space, each by one task, which answers the chunks that
ask for bigrams of its segment, as for unigrams; so no machine holds more than a segment, whatever the corpus.

A text's tokens are its words, A to Z in lower case, and one end. Null texts have the end alone. A null id counts as the empty text when rows are split
into training and held-out ones. Repeated rows, and rows of one id, count and are scored each; nothing depends on their order. Only the two named columns are
read, whatever others are called. A text of any length is part of one chunk, whose task holds it and its tokens (some 50 bytes a token). With nothing to learn from, V and N are 0
and every token has probability 1 (0.5 / 0.5). Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, ready
from gridloom.llm.exchange import Answers, Chunk, Merged, blobs, chunks, exchanged, mixed, segments, stage

BITS_PER_ITEM = 10
HASHES = 5
LOG_BASE = 1.5
#: Enough for counts of 64 bits, so none is cut.
LEVELS = 110
STRENGTH = 30.0
END, START = np.uint64(0x51ED270B7A3F1C55), np.uint64(0xC2B2AE3D27D4EB4F)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each factor of ``LOG_BASE``."""
    return np.minimum(LEVELS, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0, 1 for level 1."""
    low = np.ceil(LOG_BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(LOG_BASE ** (levels * 1.0) - 1e-9) - 1)
    return np.where(levels == 0, 0.0, (low + high) / 2)


def _positions(keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mixed(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = mixed(a ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        for i in range(HASHES):
            yield ((a + np.uint64(i) * b) >> np.uint64(16)) % sizes


def build_filter(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Bits and bytes of the filter of these n-grams."""
    levels = level_of(counts)
    size = max(64, int(levels.sum()) * BITS_PER_ITEM)
    bits = np.zeros(-(-size // 8), np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, np.uint64(size)):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return size, bits.tobytes()


class Filter:
    """Filters of all segments, end to end."""

    def __init__(self, parts: list[tuple[int, int, bytes]], count: int) -> None:
        known = {s: (n, b) for s, n, b in parts}
        rows = [known.get(s, (64, bytes(8))) for s in range(count)]
        self.sizes = np.array([n for n, _ in rows], np.uint64)
        self.first = np.cumsum([0, *(8 * len(b) for _, b in rows[:-1])]).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(b for _, b in rows), np.uint8)
        self.edges = np.array([(s << 64) // count for s in range(1, count)], np.uint64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return count_of(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """By probing levels from 1 up until one is missing."""
        segment = np.searchsorted(self.edges, keys, side="right")
        sizes, first = self.sizes[segment], self.first[segment]
        levels = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            if not len(alive):
                break
            k, n, f = keys[alive], sizes[alive], first[alive]
            here = np.ones(len(alive), bool)
            for at in _positions(k, level, n):
                p = at + f
                here &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
            alive = alive[here]
            levels[alive] = level
        return levels


class Tokens:
    """A chunk's tokens: words and an end for each document."""

    def __init__(self, chunk: Chunk, held_out: Callable[[int | None], bool]) -> None:
        n = len(chunk.ids)
        self.ends = chunk.ends + np.arange(1, n + 1)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.h = np.full(chunk.size + n, END, np.uint64)
        last = np.zeros(len(self.h), bool)
        last[self.ends - 1] = True
        self.h[~last] = chunk.hashes()
        self.out = np.array([held_out(i) for i in chunk.ids], bool)
        self.trains = np.repeat(~self.out, self.ends - self.starts)
        before = np.concatenate(([START], self.h[:-1]))
        before[self.starts] = START
        with np.errstate(over="ignore"):
            self.pairs = mixed(before * np.uint64(0x9FB21C651E98DF25) + self.h)
        self.ranked, self.back = np.unique(self.h, return_inverse=True)


def crc_is(remainder: int, of: int) -> Callable[[int | None], bool]:
    return lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % of == remainder


_SENT = "segment int, chunk long, blob binary"


def score(docs: DataFrame, held_out: Callable[[int | None], bool], id_col: str = "doc_id", text: str = "text", strength: float = STRENGTH) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row; scores are log10 probabilities."""
    spark = ready(docs.sparkSession)
    staged = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", lower=True)
    count = segments(staged.agg(F.sum("words")).first()[0] or 0)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in chunks(batches):
            t = Tokens(chunk, held_out)
            yield from blobs(number, count, t.ranked, np.bincount(t.back, t.trains, len(t.ranked)).astype(np.uint32))

    def sum_words(segment: int, m: Merged) -> Iterator[tuple[int, bytes]]:
        total = m.total(1)
        yield from m.answers(total.astype(np.uint64)[m.group])
        yield -1, f"{int((total > 0).sum())},{int(total.sum())}".encode()

    counted = exchanged(staged.mapInArrow(send_words, _SENT), sum_words)
    words = Answers(counted, "unigrams")
    sums = spark.read.schema("segment int, chunk long, blob binary, bucket long").parquet(words.path).where("bucket = -1").select(F.col("blob").cast("string").alias("x"))
    v, n = (int(x or 0) for x in sums.agg(*(F.sum(F.split_part("x", F.lit(","), F.lit(i)).cast("long")) for i in (1, 2))).first())

    def count_training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([sum(not held_out(i) for x in ids for i in x)], pa.int64())], names=["n"])

    trained = staged.select("ids").mapInArrow(count_training, "n long").agg(F.sum("n")).first()[0] or 0

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in chunks(batches):
            t = Tokens(chunk, held_out)
            keys, back = np.unique(t.pairs, return_inverse=True)
            yield from blobs(number, count, keys, np.bincount(back, t.trains, len(keys)).astype(np.uint32))

    def probe_pairs(segment: int, m: Merged) -> Iterator[tuple[int, bytes]]:
        total = m.total(1)
        keys = m.columns[0][m.order][m.starts]
        seen = total > 0
        known = Filter([(segment, *build_filter(keys[seen], total[seen]))], count)
        yield from m.answers(known.levels(keys).astype(np.uint8)[m.group])

    pairs = Answers(exchanged(staged.mapInArrow(send_pairs, _SENT), probe_pairs), "bigrams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, read_pairs = words.reader(), pairs.reader()
        for number, chunk in chunks(batches):
            t = Tokens(chunk, held_out)
            answers = read(number)
            c = np.concatenate([a[0] for a in answers]).astype(np.int64)[t.back]
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            before = np.concatenate(([0], c[:-1]))
            before[t.starts] = trained
            _, back = np.unique(t.pairs, return_inverse=True)
            levels = np.concatenate([a[0] for a in read_pairs(number)]).astype(np.int64)
            pair = np.minimum(count_of(levels)[back], np.minimum(before, c))
            q = (pair + strength * p) / (before + strength)
            base, smoothed = (np.add.reduceat(np.log10(x), t.starts) for x in (p, q))
            yield batch_of(schema, chunk.ids, t.out, t.ends - t.starts, np.add.reduceat((c > 0).astype(np.int64), t.starts), np.full(len(t.out), n), base, smoothed)

    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return staged.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
