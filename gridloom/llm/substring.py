"""Removal of long repeats by fixed-block anchors.

Every document's non-overlapping blocks of half a window are the index; its
rolling windows of that length are the probes. Any window of two blocks less one word holds a whole block, so
two equal windows of ``window`` words hold an equal block at an equal place. Pass 1 brings all
rolling hashes together, as exchanges do, and finds those that stand twice or more, once as an indexed block.
Pass 2 extends each hit, in either direction, to every full window whose first indexed block it may be, and brings these together:
a window is removed if a smaller document has the same. Pass 3 joins the windows
into maximal repeats and takes their words out.

Hits of pass 1 are candidates only, so its hashes may be short; those of pass 2 have 96 bits.

Null or blank texts have no words. Documents with a null id are left as they
are, and remove nothing. Documents of one id, repeated rows among them, don't remove words from one another; neither does a document from itself. Empty tables give
empty tables. Only the two named columns are read, whatever others are called. A text of any length is part of one chunk, whose task holds it (some
100 bytes a word).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ready
from gridloom.llm.exchange import Answers, Chunk, Merged, blobs, chunks, exchanged, mixed, part, segments, stage

WINDOW = 50
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LANE = np.uint64(0xD6E8FEB86659FD93)


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` values: a polynomial modulo 2**64 in an odd base, mixed."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(h)
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE))))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - length, _BACK))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up)))
        return mixed((sums[length:] - sums[:-length]) * down)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each in ``order``, and the order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    return s[first], first, order


class Anchors:
    """A chunk's rolling windows of a block's length."""

    def __init__(self, chunk: Chunk, block: int) -> None:
        named = np.array([i is not None for i in chunk.ids], bool)
        self.word_hashes = chunk.hashes()
        self.of = chunk.of()
        self.at = np.arange(chunk.size) - chunk.starts[self.of] if chunk.size else np.zeros(0, np.int64)
        left = chunk.ends[self.of] - np.arange(chunk.size) if chunk.size else np.zeros(0, np.int64)
        self.left = np.where(named[self.of], left, 0) if chunk.size else left
        self.h = rolling(self.word_hashes, block)
        #: Starts of windows that lie in one document with an id.
        self.places = np.flatnonzero(self.left[: len(self.h)] >= block)
        self.block = block


def _send_anchors(block: int, count: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in chunks(batches):
            a = Anchors(chunk, block)
            h, first, order = _distinct(a.h[a.places])
            if len(h):
                indexed = np.maximum.reduceat((a.at[a.places[order]] % block == 0).astype(np.uint32), first)
                twice = (np.diff(np.concatenate((first, [len(order)]))) > 1).astype(np.uint32)
                yield from blobs(number, count, h, (a.places[order[first]].astype(np.uint32) << np.uint32(2)) | indexed << np.uint32(1) | twice, bits=bits)

    return run


def _repeated(_: int, m: Merged) -> Iterator[tuple[int, bytes]]:
    flags = m.columns[1]
    indexed = np.bitwise_or.reduceat((flags & 3)[m.order], m.starts)
    several = np.diff(np.concatenate((m.starts, [len(m.order)]))) > 1
    hit = (indexed & 2 > 0) & ((indexed & 1 > 0) | several)
    return m.answers(flags >> np.uint32(2), hit[m.group])


class Windows:
    """A chunk's full windows about the hits of pass 1."""

    def __init__(self, chunk: Chunk, block: int, window: int, hits: np.ndarray) -> None:
        a = Anchors(chunk, block)
        found = np.zeros(chunk.size + 1, np.int64)
        if len(hits):
            same = a.places[np.isin(a.h[a.places], a.h[hits])]
            # The first indexed block of a window starts at one of its first `block` words, in the document that it was indexed from.
            np.add.at(found, np.maximum(same - block + 1, chunk.starts[a.of[same]]), 1)
            np.add.at(found, same + 1, -1)
        self.places = np.flatnonzero((np.cumsum(found[:-1]) > 0) & (a.left >= window)) if chunk.size else np.zeros(0, np.int64)
        self.h = rolling(a.word_hashes, window)[self.places]
        with np.errstate(over="ignore"):
            self.check = (rolling(mixed(a.word_hashes + _LANE), window)[self.places] >> np.uint64(32)).astype(np.uint32)
        self.doc = np.array([0 if i is None else i for i in chunk.ids], np.int64)[a.of[self.places]] if chunk.size else np.zeros(0, np.int64)
        self.of = a.of[self.places] if chunk.size else np.zeros(0, np.int64)


def _send_windows(block: int, window: int, count: int, hits: Answers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = hits.reader()
        for number, chunk in chunks(batches):
            w = Windows(chunk, block, window, part(read, number, 0, np.int64))
            h, first, order = _distinct(w.h)
            if len(h):
                least = np.minimum.reduceat(w.doc[order], first)
                yield from blobs(number, count, h, w.check[order[first]], w.places[order[first]].astype(np.uint32), least.view(np.uint64))

    return run


def _seen_before(_: int, m: Merged) -> Iterator[tuple[int, bytes]]:
    """Windows of which a smaller document, of another chunk, has the same."""
    h, check, place, doc = m.columns
    doc = doc.view(np.int64)
    order = np.lexsort((doc, check, h))
    h, check = h[order], check[order]
    start = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
    least = doc[order][np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))]
    hit = np.empty(len(doc), bool)
    hit[order] = least < doc[order]
    return m.answers(place, hit)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, removed, kept_text)`` for each row.

    ``removed`` has the maximal repeats as (start, end) in words; ``kept_text`` is the kept words joined by one space.
    """
    ready(docs.sparkSession)
    block = (window + 1) // 2
    staged = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text")
    total = staged.agg(F.sum("words")).first()[0] or 0
    count = segments(total)
    # Short hashes suffice where chance hits stay rare: 13 bits beyond the number of windows.
    bits = min(64, max(40, math.ceil(math.log2(total + 2)) + 13))
    sent = staged.mapInArrow(_send_anchors(block, count, bits), "segment int, chunk long, blob binary")
    hits = Answers(exchanged(sent, _repeated), "anchors")
    found = staged.mapInArrow(_send_windows(block, window, count, hits), "segment int, chunk long, blob binary")
    seen = Answers(exchanged(found, _seen_before), "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_hits, read_seen = hits.reader(), seen.reader()
        for number, chunk in chunks(batches):
            anchors = part(read_hits, number, 0, np.int64)
            gone = np.zeros(chunk.size + 1, np.int64)
            if len(anchors):
                w = Windows(chunk, block, window, anchors)
                _, first, order = _distinct(w.h)
                if len(order):
                    least = np.minimum.reduceat(w.doc[order], first)
                    group = np.empty(len(order), np.int64)
                    group[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(order)]))))
                    elsewhere = np.isin(w.places[order[first]], part(read_seen, number, 0, np.int64))
                    hit = w.places[elsewhere[group] | (w.doc > least[group])]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + window, -1)
            removed = np.cumsum(gone[:-1]) > 0
            for lo in range(0, len(chunk.ids), 256):
                yield _kept(chunk, removed, lo, min(lo + 256, len(chunk.ids)))

    return staged.select("chunk", "ids", "texts").mapInArrow(cut, "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string").withColumnRenamed("id", id_col)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _kept(chunk: Chunk, removed: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
    counts, spans, texts = [], [], []
    for i in range(lo, hi):
        r, words = removed[chunk.starts[i] : chunk.ends[i]], chunk.words[i]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], r.view(np.int8), [0]))))
        counts.append(int(r.sum()))
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        texts.append(b" ".join(words if not counts[-1] else [w for w, x in zip(words, r.tolist(), strict=True) if not x]).decode())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk.ids[lo:hi], pa.int64()), pa.array([len(chunk.words[i]) for i in range(lo, hi)], pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(texts, pa.string())],
        names=["id", "n_words", "n_removed", "removed", "kept_text"],
    )
