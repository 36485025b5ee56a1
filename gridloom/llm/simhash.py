"""SimHash fingerprints, and links between near ones through a byte-position index.

A fingerprint of 64*k bits has 8*k byte positions. An inverted index over bytes
at positions lists who has which byte where. Two fingerprints that differ in at
most d bits differ in at most d bytes, so they share at least 8*k-d positional
bytes: the count filter. Lists by one byte would hold 1/256 of everything, so
the index is over sets of positions, chosen such that any pair that can pass
the count filter shares at least one whole set. In each list the shared
positional bytes of the pairs are tallied, pairs that reach the guaranteed
minimum stay, and those are verified on all bits.

Copies cost nothing: the index holds distinct fingerprints. A list gives the
links of a spanning forest of its linked members, not all its pairs. Lists are
counted first. One of more than ``HOT`` members never is in one task: it is dealt anew by all larger sets of positions that a
linked pair must share, and what is then still long is searched by flipping
bits, at a fixed cost for each member, so no list costs the square of its size.

For pairs of similarity 0.8 or so, whose 64-bit fingerprints are far apart, use
``wide_index``: more bits and many sets of two positions or a little more, planned such that a text is compared with about
as many others whatever the corpus. There the similarity that the distance and the counts of shingles stand for only
proposes pairs, from ``LOOSE`` on; what is proposed is decided by the exact Jaccard similarity of its shingle hashes. See
``near_duplicates``. Long lists are cut into blocks, and each pair of blocks is a list of its own, so no
link is lost to the length of a list; that work is spread, but grows with the square of the list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, key_blocks, numbered, ready, row_key, runs, temporary, utf8, written
from gridloom.llm.components import connected_components

#: Members up to which a list's pairs are compared one with another.
HOT = 4096
SEED = 42
#: How far below the wanted similarity the estimate of a pair to be decided may be, about four times its error.
LOOSE = 0.15
#: Chance by plan that a pair at the wanted similarity shares a set; bits of real texts depend on one another, so the measured one is lower.
RECALL = 0.995
#: Unrelated fingerprints that one is compared with at most, in all lists: more members get longer keys.
COMPARED = 4608
#: Sets of positions by which close pairs are met first.
FIRST = 8
#: Lanes of the fine fingerprints that thin out proposed pairs, and how far below the wanted similarity their estimate may be, above three times its error.
FINE, NEAR = 32, 0.06


# ---------------------------------------------------------------- fingerprints
def shingles(text: bytes, size: int) -> list[bytes]:
    """Shingles of ``size`` words joined by a space; of fewer words the whole sequence; of none nothing."""
    w = text.lower().split()
    if not w:
        return []
    if len(w) <= size:
        return [b" ".join(w)]
    line = b" ".join(w)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [line[a:b] for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def hashes(text: bytes, size: int) -> np.ndarray:
    s = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), np.uint64, len(s))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; the others are independent mixes of it."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + _MIX[0] * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian; a bit is 1 if it is set in over half of the hashes; zeros if there are none."""
    out = b""
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        x = _remix(h, lane)
        for lo in range(0, len(x), 255 * 64):
            bits = np.unpackbits(x[lo : lo + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            full = len(bits) // 255 * 255
            if full:
                ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            ones += bits[full:].sum(axis=0, dtype=np.uint8)
        out += np.packbits((2 * ones > len(x)).astype(np.uint8)).tobytes()
    return out


def with_fingerprints(docs: DataFrame, size: int, lanes: int = 1, text: str = "text", distinct: bool = False) -> DataFrame:
    """``docs`` without the text, with ``fp`` (binary), ``n_shingles`` (long) and ``words_key`` (binary: 16 bytes that say which word sequence it is).

    A null text counts as empty: fingerprint of zeros.
    """
    keep = [c for c in docs.columns if c not in (text, "fp", "n_shingles", "words_key")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))
    cols = (F.lit(b"").alias("fp"), F.lit(0).cast("long").alias("n_shingles"), F.lit(b"").alias("words_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, counts, keys = [], [], []
            for t in utf8(batch.column(batch.num_columns - 1)):
                h = hashes(t, size)
                if distinct:
                    h = np.unique(h)
                fps.append(fingerprint(h, lanes))
                counts.append(len(h))
                keys.append(xxhash.xxh3_128_digest(b" ".join(t.lower().split())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())], names=[*keep, "fp", "n_shingles", "words_key"])

    ready(docs.sparkSession)
    return numbered(source).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep), *cols).schema)


# ---------------------------------------------------------------------- index
@dataclass(frozen=True)
class Index:
    """``sets``: sets of byte positions. A pair links if it shares ``min_bytes`` positional bytes and then

    differs in ``max_bits`` bits at most, or, if ``min_similarity`` is set, its
    estimated Jaccard similarity of shingle sets is at least that.
    """

    positions: int
    sets: tuple[tuple[int, ...], ...]
    min_bytes: int
    max_bits: int
    min_similarity: float | None = None
    refined: tuple[tuple[int, ...], ...] = ()
    #: Leading bits of a set's last byte that count.
    last_bits: int = 8

    @property
    def guaranteed(self) -> bool:
        return self.min_similarity is None


def exact_index(max_bits: int = 3) -> Index:
    """For 64-bit fingerprints. Of any five of eight positions, three lie in one half, so the triples of both halves meet every pair within three bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the sets of positions here serve distances up to 3")
    sets = tuple(c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3))
    return Index(8, sets, 8 - max_bits, max_bits, refined=tuple(combinations(range(8), 5)))


def wide_plan(members: int, similarity: float = 0.8, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of sets for so many fingerprints: at least 16 bits, then as many as keep the comparisons at ``COMPARED``."""
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 16
    while True:
        sets = math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
        if members / 2**bits * sets <= COMPARED or bits == 40:
            return bits, sets
        bits += 1


def wide_index(members: int = 0, lanes: int = 6, similarity: float = 0.8, least: float | None = None, seed: int = 5) -> Index:
    """Sets of positions, drawn with a seed, for so many fingerprints. Pairs link from an estimated similarity of ``least`` on."""
    n = 8 * lanes
    bits, sets = wide_plan(members, similarity)
    size = -(-bits // 8)
    rng = np.random.default_rng(seed)
    order = [tuple(sorted(p.tolist())) for _ in range(-(-sets // (n // size))) for p in rng.permutation(n)[: n // size * size].reshape(-1, size)]
    return Index(n, tuple(order[:sets]), 4, 64 * lanes, similarity if least is None else least, last_bits=bits - 8 * (size - 1))


def similarity(bits: np.ndarray, width: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of two sets of ``n_a`` and ``n_b`` members whose fingerprints differ in ``bits`` of ``width``."""
    cos = np.cos(np.pi * bits / width)
    shared = cos * np.sqrt(n_a * n_b)
    return shared / np.maximum(n_a + n_b - shared, 1e-9)


def _linked(index: Index, fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tally the shared positional bytes of pairs of rows, retain those that reach the minimum, verify."""
    differ = fp[i] ^ fp[j]
    ok = (differ == 0).sum(axis=1) >= index.min_bytes
    at = np.flatnonzero(ok)
    bits = np.bitwise_count(differ[at]).sum(axis=1, dtype=np.int64)
    if index.min_similarity is None:
        ok[at] = bits <= index.max_bits
    else:
        ok[at] = similarity(bits, 8 * index.positions, n[i[at]].astype(float), n[j[at]].astype(float)) >= index.min_similarity
    return ok


#: Members up to which all pairs of a list are formed at once, together with those of other lists.
SHORT = 48


def _short_lists(index: Index, keys: np.ndarray, fp: np.ndarray, n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of one key; ``ends``: for each row where its list ends, or the row itself to leave it out."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.arange(len(keys))
    for apart in range(1, SHORT):
        i = rows = rows[rows + apart < ends[rows]]
        if not len(i):
            break
        ok = _linked(index, fp, n, i, i + apart)
        left.append(i[ok])
        right.append(i[ok] + apart)
    return np.concatenate(left), np.concatenate(right)


def _forest(index: Index, fp: np.ndarray, n: np.ndarray, side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Spanning forest of a list's links: rows reached one from another, each compared with those not yet reached.

    With ``side`` (0 or 1 of each row) of the links between the two sides alone.
    """
    waiting = [np.arange(len(fp))] if side is None else [np.flatnonzero(side == s) for s in (0, 1)]
    left: list[int] = []
    right: list[int] = []
    while len(waiting[0]) and len(waiting[-1]):
        reached, waiting[0] = [int(waiting[0][0])], waiting[0][1:]
        while reached:
            at = reached.pop()
            to = 0 if side is None else 1 - int(side[at])
            if not len(waiting[to]):
                continue
            ok = _linked(index, fp, n, np.full(len(waiting[to]), at), waiting[to])
            new = waiting[to][ok].tolist()
            left += [at] * len(new)
            right += new
            reached += new
            waiting[to] = waiting[to][~ok]
    return left, right


def _flipped(index: Index, free: Sequence[int], fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Links among distinct fingerprints that agree outside the ``free`` bytes: every flip of up to ``max_bits`` of their bits is looked up."""
    value = np.ascontiguousarray(fp).view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(value, kind="stable")
    value = value[order]
    bits = [np.uint64(1) << np.uint64(63 - 8 * p - k) for p in free for k in range(8)]
    left: list[int] = []
    right: list[int] = []
    root = np.arange(len(value))
    for size in range(1, index.max_bits + 1):
        for flip in combinations(bits, size):
            other = value ^ np.bitwise_xor.reduce(np.array(flip))
            at = np.minimum(np.searchsorted(value, other), len(value) - 1)
            hit = np.flatnonzero((value[at] == other) & (root[at] < root))  # a link to a row already in the same tree tells nothing
            left += order[hit].tolist()
            right += order[at[hit]].tolist()
            root[hit] = root[at[hit]]
    return left, right


def _thinned(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the links between rows that connect what all of them connect; links of small ids come first, in all lists alike."""
    a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    root: dict[int, int] = {}
    keep = []
    order = np.lexsort((b, a))
    for at, i, j in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        while (up := root.get(j, j)) != j:
            root[j] = j = root.get(up, up)
        if i != j:
            root[i] = j
            keep.append(at)
    return a[keep], b[keep]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(index: Index, sets: Sequence[tuple[int, ...]], hot: int, last: bool = False, sides: bool = False):
    """Reads (key, id, n, fp) sorted by key; gives links.

    ``last``: a list longer than ``hot`` has few free bytes and is searched by flips. ``sides``: a
    row has a side besides, and rows are compared with those of the other side, if their list has two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, n, fp, *side in key_blocks(batches, 0, {3: index.positions}):
            starts, ends = runs(keys)
            short = (ends - starts <= SHORT) & (not sides)
            end_of = np.repeat(np.where(short, ends, 0), ends - starts)
            i, j = _short_lists(index, keys, fp, n, end_of)
            left, right = [i], [j]
            for lo, hi in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
                if last and hi - lo > hot:
                    which = int(np.uint64(keys[lo]) >> np.uint64(48))
                    a, b = _flipped(index, [p for p in range(8) if p not in sets[which]], fp[lo:hi])
                else:
                    two = sides and side[0][lo:hi].any()
                    a, b = _forest(index, fp[lo:hi], n[lo:hi], side[0][lo:hi] if two else None)
                left.append(np.array(a, np.int64) + lo)
                right.append(np.array(b, np.int64) + lo)
            a, b = _thinned(ids, np.concatenate(left), np.concatenate(right))
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield batch_of(_LINKS, pairs[:, 0], pairs[:, 1])

    return run


def _posted(rows: DataFrame, sets: Sequence[tuple[int, ...]], *more: str, last_bits: int = 8) -> DataFrame:
    """Postings: the set's number in the top bytes of the key, the bits at its positions below."""

    def key(i: int, s: tuple[int, ...]):
        joined = F.concat(*(F.substring("fp", p + 1, 1) for p in s))
        return F.lit(i << 48).bitwiseOR(F.shiftrightunsigned(F.conv(F.hex(joined), 16, 10).cast("long"), 8 - last_bits))

    keys = F.array(*(key(i, s) for i, s in enumerate(sets)))
    return rows.select(F.explode(keys).alias("key"), "id", "n", "fp", *more)


def _dealt(postings: DataFrame, run, schema: str = "a long, b long") -> DataFrame:
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def links(fingerprints: DataFrame, index: Index, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` that connect all linked fingerprints of ``(id, n, fp)``, which are distinct by id."""
    posted = _posted(fingerprints, index.sets, last_bits=index.last_bits)
    long_lists = posted.groupBy("key").count().where(F.col("count") > hot)
    long_lists = written(long_lists.select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "long")
    if long_lists.isEmpty():
        return _dealt(posted, _search(index, index.sets, hot))
    first = _dealt(posted.join(long_lists, "key", "left_anti"), _search(index, index.sets, hot))
    members = posted.join(long_lists, "key")
    if not index.guaranteed:
        return first.unionAll(_dealt(_block_pairs(members), _search(index, index.sets, hot, sides=True)))
    # Each linked pair of a long list shares one of the larger sets that hold the list's own set.
    within = [[j for j, r in enumerate(index.refined) if set(s) <= set(r)] for s in index.sets]
    allowed = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in within)), F.shiftrightunsigned("key", 48).cast("int") + 1)
    member = members.select("id", "n", "fp", F.explode(allowed).alias("r")).distinct()
    finer = _posted(member.select("id", "n", "fp").distinct(), index.refined).join(
        member.select("id", "r").distinct().withColumnRenamed("id", "id2"),
        (F.col("id") == F.col("id2")) & (F.shiftrightunsigned("key", 48) == F.col("r")),
        "left_semi",
    )
    return first.unionAll(_dealt(finer, _search(index, index.refined, hot, last=True)))


def _block_pairs(members: DataFrame, *more: str) -> DataFrame:
    """Long lists as lists of each block by itself and of each two blocks, the second of them on side 1; so any two members meet."""
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return both.select(key.alias("key"), "id", "n", "fp", *more, (F.col("own") > F.col("other")).cast("int").alias("side"))


def _others(group: np.ndarray, side: np.ndarray | None, i: int, lo: int, hi: int) -> np.ndarray:
    """Rows in [lo, hi) of another group than row i, and of the other side if there are two."""
    other = group[lo:hi] != group[i]
    if side is not None:
        other &= side[lo:hi] != side[i]
    return np.flatnonzero(other) + lo


def _flag(index: Index, sides: bool):
    """Reads (key, id, n, fp, group) sorted by key, and a side with ``sides``; gives the ids that ``index`` links with one of another group.

    A row is compared with its list only while nothing has linked it, so lists in which most are linked cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, n, fp, group, *side in key_blocks(batches, 0, {3: index.positions}):
            starts, ends = runs(keys)
            flagged = np.zeros(len(keys), bool)
            short = (ends - starts <= SHORT) & (not sides)
            end_of, rows = np.repeat(np.where(short, ends, 0), ends - starts), np.arange(len(keys))
            for apart in range(1, SHORT):
                rows = rows[rows + apart < end_of[rows]]
                if not len(rows):
                    break
                i = rows[(group[rows] != group[rows + apart]) & ~(flagged[rows] & flagged[rows + apart])]
                i = i[_linked(index, fp, n, i, i + apart)]
                flagged[i] = flagged[i + apart] = True
            for lo, hi in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
                two = side[0] if sides and side[0][lo:hi].any() else None
                for i in range(lo, hi):
                    if not flagged[i]:
                        j = _others(group, two, i, lo, hi)
                        j = j[_linked(index, fp, n, np.full(len(j), i), j)]
                        flagged[j] = True
                        flagged[i] = len(j) > 0
            if flagged.any():
                yield batch_of(_IDS, np.unique(ids[flagged]))

    return run


_IDS = pa.schema([("id", pa.int64())])
_PROPOSED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group_a", pa.int64()), ("group_b", pa.int64()), ("estimate", pa.float64())])


def _propose(index: Index, fine_bytes: int, least: float, wanted: float, sides: bool):
    """Reads (key, id, n, fp, group, fine, which) sorted by key, and a side with ``sides``; gives the pairs of different groups

    that ``index`` links and whose estimate by the fine fingerprints is ``least`` or more. A pair is given in the first set that it shares.
    """
    mask = np.uint8(0xFF << (8 - index.last_bits) & 0xFF)

    def earlier(differ: np.ndarray, which: int) -> np.ndarray:
        """Whether pairs share one of the sets before this."""
        found = np.zeros(len(differ), bool)
        for s in index.sets[:which]:
            apart = differ[:, s[-1]] & mask
            for p in s[:-1]:
                apart = apart | differ[:, p]
            found |= apart == 0
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, n, fp, group, fine, which, *side in key_blocks(batches, 0, {3: index.positions, 5: fine_bytes}, 1 << 15):

            def given(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                ok = _linked(index, fp, n, i, j)
                i, j = i[ok], j[ok]
                sizes = n[i].astype(float), n[j].astype(float)
                estimate = similarity(np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64), 8 * fine_bytes, *sizes)
                ok = (estimate >= least) & (np.minimum(*sizes) >= wanted * np.maximum(*sizes))
                i, j, estimate = i[ok], j[ok], estimate[ok]
                differ, new = fp[i] ^ fp[j], np.ones(len(i), bool)
                for number in np.unique(which[i]).tolist():
                    at = np.flatnonzero(which[i] == number)
                    new[at] = ~earlier(differ[at], number)
                i, j, estimate = i[new], j[new], estimate[new]
                if len(i):
                    first = ids[i] < ids[j]
                    i, j = np.where(first, i, j), np.where(first, j, i)
                    yield batch_of(_PROPOSED, ids[i], ids[j], group[i], group[j], estimate)

            starts, ends = runs(keys)
            short = (ends - starts <= SHORT) & (not sides)
            end_of, rows = np.repeat(np.where(short, ends, 0), ends - starts), np.arange(len(keys))
            for apart in range(1, SHORT):
                rows = rows[rows + apart < end_of[rows]]
                if not len(rows):
                    break
                i = rows[group[rows] != group[rows + apart]]
                yield from given(i, i + apart)
            for lo, hi in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
                two = side[0] if sides and side[0][lo:hi].any() else None
                for i in range(lo, hi - 1):
                    j = _others(group, two, i, i + 1, hi)
                    yield from given(np.full(len(j), i), j)

    return run


def _in_lists(posted: DataFrame, hot: int, run, schema: str, *more: str) -> DataFrame:
    """``run(sides)`` over the lists of postings; those of more than ``hot`` members by pairs of blocks."""
    long_lists = posted.groupBy("key").count().where(F.col("count") > hot)
    long_lists = written(long_lists.select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "long")
    if long_lists.isEmpty():
        return _dealt(posted, run(False), schema)
    members = posted.join(long_lists, "key")
    return _dealt(posted.join(long_lists, "key", "left_anti"), run(False), schema).unionAll(_dealt(_block_pairs(members, *more), run(True), schema))


def flagged(fingerprints: DataFrame, index: Index, hot: int = HOT) -> DataFrame:
    """The ids of ``(id, n, fp, group)`` that share a set of positions with one of another group and are linked with it by ``index``."""
    posted = _posted(fingerprints, index.sets, "group", last_bits=index.last_bits)
    return _in_lists(posted, hot, lambda sides: _flag(index, sides), "id long", "group").distinct()


def proposed(fingerprints: DataFrame, index: Index, fine_lanes: int, least: float, wanted: float, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, b, group_a, group_b, estimate)`` of ``(id, n, fp, group, fine)`` of different groups, each once, that ``index`` links,

    whose fine fingerprints stand for a similarity of ``least`` or more and whose sizes allow the ``wanted`` one.
    """
    posted = _posted(fingerprints, index.sets, "group", "fine", last_bits=index.last_bits).withColumn("which", F.shiftrightunsigned("key", 48).cast("int"))
    schema = "a long, b long, group_a long, group_b long, estimate double"
    return _in_lists(posted, hot, lambda sides: _propose(index, 8 * fine_lanes, least, wanted, sides), schema, "group", "fine", "which")


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``(id, hashes)`` of ``(id, text)``: the distinct shingle hashes, in order, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(t, size)).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary")


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, min_similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sets of shingle hashes have the Jaccard similarity; ``texts`` gives ``(id, text)`` for a table of ids."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(_shingle_sets(texts(wanted), size).dropDuplicates(["id"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y)
                least = min(len(x), len(y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if least >= min_similarity * (both - least) else 0
                keep.append(shared > 0 and shared / (both - shared) >= min_similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    of = lambda end: sets.select(F.col("id").alias(end), F.col("hashes").alias(f"hashes_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hashes_a", "hashes_b")
    return written(both.mapInArrow(run, "a long, b long"), "verified")


# ------------------------------------------------------------------- operators
def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, max_bits: int = 3, hot: int = HOT) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row: links at ``max_bits`` or fewer differing bits of 64-bit fingerprints.

    Rows with a null id keep a null component if nothing with an id shares their
    fingerprint; they link nothing. Repeated rows and ids are rows like any others, so of ties all get the same component. Null and
    blank texts have the fingerprint zero. Only the two named columns are read, whatever others are called. Texts are fingerprinted one at a time.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    with temporary(ready(docs.sparkSession)):
        rows = written(with_fingerprints(source, size).select("id", "fp"), "fingerprints", outer=True)
        same = written(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
        many = same.select(F.col("rep").alias("id"), F.lit(1).cast("long").alias("n"), "fp")
        found = connected_components(links(many, exact_index(max_bits), hot))
        label = same.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        label = written(label, "labels", outer=True)
    return rows.join(label, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, min_similarity: float = 0.8, lanes: int = 6, hot: int = HOT) -> DataFrame:
    """``(id, row_key, component_id, first)``: texts of one word sequence, or whose shingle sets have the Jaccard similarity, share a component.

    ``row_key`` is of all of the row's values. Rows of one id with different texts are different texts; ``first`` says
    which row is the component's smallest by id and row key.

    The fingerprints only propose pairs; what links is decided by shingle hashes. Close pairs come first, a spanning forest of
    each list. Texts that may be linked with one of another group then get fine fingerprints, and pairs whose fine estimate is
    near the wanted similarity are decided: first one of each two groups, then all between groups that are still apart.
    Null or blank texts are copies of one another. Rows with a null id are left out; of repeated rows each is ``first`` if one is. Column names
    don't clash with anything here. A text of any length is fingerprinted by itself; its set of shingle hashes has 8 bytes a shingle.
    An empty table gives an empty one.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), row_key(docs.columns).alias("row_key")).where("id is not null")
    with temporary(ready(docs.sparkSession)):
        rows = with_fingerprints(source, size, lanes, distinct=True).withColumn("node", F.xxhash64("words_key"))
        rows = written(rows.select("node", "id", "row_key", "fp", F.col("n_shingles").alias("n")), "fingerprints", outer=True)
        same = written(rows.groupBy("node").agg(F.min(F.struct("id", "row_key")).alias("best"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct")
        some = same.where("n > 0").select(F.col("node").alias("id"), "n", "fp")

        def texts(ids: DataFrame) -> DataFrame:
            keys = same.join(ids, F.col("node") == F.col("id"), "left_semi").select("node", F.col("best.row_key").alias("row_key"), F.col("best.id").alias("id"))
            return source.join(keys, ["id", "row_key"]).select(F.col("node").alias("id"), "text")

        near = wide_index(some.count(), lanes, min_similarity, min_similarity - LOOSE)
        close = replace(near, sets=near.sets[:FIRST], min_similarity=min_similarity + LOOSE / 3)
        first = verified(written(links(some, close, hot).distinct(), "close"), texts, size, min_similarity)
        groups = connected_components(first).select(F.col("node").alias("id"), "component")
        grouped = written(some.join(groups, "id", "left").select("id", "n", "fp", F.coalesce("component", "id").alias("group")), "groups")
        some_texts = texts(written(flagged(grouped, near, hot), "flagged")).select("id", "text")
        fine = with_fingerprints(some_texts, size, FINE, distinct=True).select("id", F.col("fp").alias("fine")).dropDuplicates(["id"])
        pairs = written(proposed(grouped.join(written(fine, "fine"), "id"), near, FINE, min_similarity - NEAR, min_similarity, hot), "proposed")
        # Of each two groups the likeliest pair is decided first; what that joins needs no more pairs.
        best = pairs.groupBy(F.least("group_a", "group_b"), F.greatest("group_a", "group_b")).agg(F.max(F.struct("estimate", "a", "b", "group_a", "group_b")).alias("x")).select("x.a", "x.b", "x.group_a", "x.group_b")
        best = written(best, "best")
        likely = verified(best.select("a", "b"), texts, size, min_similarity)
        joined = written(connected_components(likely.join(best, ["a", "b"]), "group_a", "group_b"), "joined")
        of = lambda end: joined.select(F.col("node").alias(f"group_{end}"), F.col("component").alias(f"joined_{end}"))
        left = pairs.join(of("a"), "group_a", "left").join(of("b"), "group_b", "left").where(F.coalesce("joined_a", "group_a") != F.coalesce("joined_b", "group_b"))
        left = written(left.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), "left")
        rest = verified(left, texts, size, min_similarity)
        found = connected_components(first.unionAll(likely).unionAll(rest))
        label = written(same.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "best"), "labels", outer=True)
    label = label.join(label.groupBy("component").agg(F.min("best").alias("least")), "component")
    is_first = (F.col("id") == F.col("least.id")) & (F.col("row_key") == F.col("least.row_key"))
    return rows.join(label, "node").select(F.col("id").alias(id_col), "row_key", F.col("least.id").alias("component_id"), is_first.alias("first"))
