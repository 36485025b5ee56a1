"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share all words by weight; no target is above ``repeats`` times its
source, and what that leaves over is shared anew by weight. The words are cut
into equal blocks. Blocks are seats: sources get them by highest quotients of
their targets, then the shards of a source by those of their words, each at most
``repeats`` times its own blocks. In a shard the documents stand in an order drawn
from a seed, and blocks are chosen from a seeded start on, round and round, until
the quota is met. What a document gives is the overlap of its words with those
blocks, so whole runs of documents are taken.

Only per-source and per-shard sums reach the driver; shards are at most
``SHARDS`` more than there are sources, whatever the data's size. More than ``SOURCES`` sources are an error.

Null texts have no words. A null source is a source of its own, last in order.
Rows of one id are documents of their own; repeated rows are alike to the plan, and each has its own part of it. Documents without words give none.
Columns of any other name stay as they are, whatever they are called. Texts are held one at a time, so a long one costs its own size.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, ready, row_key, utf8, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARDS = 1 << 16
#: Sources whose sums the driver holds and broadcasts, at most: some 20 MB.
SOURCES = 1 << 18
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 128


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: float) -> list[float]:
    """Shares of the sum of ``sizes``; what is above ``repeats`` times a size is shared anew until nothing is."""
    out = [float(repeats * s) for s in sizes]
    left, total = sum(sizes), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])  # those that reach their limit first come first
    for at, i in enumerate(order):
        if left * weights[i] / total <= repeats * sizes[i]:
            for j in order[at:]:
                out[j] = left * weights[j] / total
            break
        left, total = left - repeats * sizes[i], total - weights[i]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes/1, votes/3, votes/5 ...; ties go to the earlier; nobody gets above ``most``.

    The divisor that gives about all seats is tried first, and single seats are
    then given or taken by quotient, so the work does not depend on the seats.
    """
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [min(m, math.floor(v * seats / total + 0.5)) for v, m in zip(votes, most, strict=True)]
    sure = sum(got)
    while sure > seats:
        worst = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g]
        heapq.heapify(worst)
        while sure > seats and worst:
            _, i = heapq.heappop(worst)
            got[-i] -= 1
            sure -= 1
            if got[-i]:
                heapq.heappush(worst, (votes[-i] / (2 * got[-i] - 1), i))
    best = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
    heapq.heapify(best)
    while sure < seats:
        _, i = heapq.heappop(best)
        got[i] += 1
        sure += 1
        if got[i] < most[i]:
            heapq.heappush(best, (-votes[i] / (2 * got[i] + 1), i))
    return got


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (long), the number of words."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("size", text)]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(t.split()) for t in utf8(batch.column(batch.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*keep, "size"])

    return numbered(source).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0).cast("long").alias("size")).schema)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, repeats: int = 3, seed: int = 17) -> DataFrame:
    """``(id, source_size, target, size, times, lo, hi, wrap, taken, row_key)`` for each document; ``row_key`` is of its id, source and text.

    Of its words, counted from 0, each is taken ``times`` times, and once more if it is in
    [lo, hi) or below ``wrap``; ``taken`` is the sum.
    """
    spark = ready(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), row_key([id_col, source, text]).alias("row_key"))
    sized = written(with_sizes(narrow), "sizes")
    found = sorted(((r.source, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    if len(found) > SOURCES:
        raise ValueError(f"{len(found)} sources; a mix has {SOURCES} at most")
    total = sum(n for _, n in found)
    goal = targets([n for _, n in found], [weights[i % len(weights)] for i in range(len(found))], repeats)
    block = max(1, min(BLOCK_WORDS, total // (256 * max(1, len(found)))))
    per_shard = max(SHARD_WORDS, -(-total // SHARDS))
    sources = [(i, s, n, g, max(1, -(-n // per_shard))) for i, ((s, n), g) in enumerate(zip(found, goal, strict=True))]
    source_rows = spark.createDataFrame(sources, "i int, source_name string, source_size long, target double, shards int")
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.when(F.col("id").isNull(), F.col("row_key")))
    dealt = sized.join(F.broadcast(source_rows), F.col("source").eqNullSafe(F.col("source_name"))).withColumn("order", order)
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")).cast("int"))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("i", "shard").agg(F.sum("size").alias("n")).where("n > 0").collect():
        sums.setdefault(r.i, []).append((r.shard, r.n))
    seats = sainte_lague(goal, round(total / block), [repeats * sum(-(-n // block) for _, n in sums.get(i, [])) for i in range(len(found))])
    quotas = []
    for i, shards in sorted(sums.items()):
        shards.sort()
        blocks = [-(-n // block) for _, n in shards]
        for (shard, _), n, quota in zip(shards, blocks, sainte_lague([n for _, n in shards], seats[i], [repeats * b for b in blocks]), strict=True):
            start = random.Random(f"{seed}:{i}:{shard}").randrange(n)
            times, more = divmod(quota, n)
            quotas.append((i, shard, times, start * block, (start + more) * block, max(0, start + more - n) * block))
    shard_rows = spark.createDataFrame(quotas, "i int, shard int, times int, first long, after long, again long")
    before = Window.partitionBy("i", "shard").orderBy("order", "id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(F.broadcast(shard_rows), ["i", "shard"], "left")
    inside = lambda word: F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce(word, F.lit(0)) - F.col("at")))
    out = placed.withColumns({"lo": inside(F.col("first")), "hi": inside(F.col("after")), "wrap": inside(F.col("again")), "times": F.coalesce("times", F.lit(0))})
    taken = F.col("times") * F.col("size") + F.col("hi") - F.col("lo") + F.col("wrap")
    return out.select(F.col("id").alias(id_col), "source", "source_size", "target", "size", "times", "lo", "hi", "wrap", taken.cast("long").alias("taken"), "row_key")


def mixed_documents(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the plan takes, as often as it does; where it takes part of a text, that part.

    Each row has a plan of its own: rows of one id, source and text, which are alike to the plan, are numbered on both sides. Other columns stay as they are.
    """
    keep = docs.columns
    ready(docs.sparkSession)
    nth = F.row_number().over(Window.partitionBy("\u0001key").orderBy("\u0001key")).alias("\u0001nth")
    steps = [f"\u0001{c}" for c in ("times", "lo", "hi", "wrap")]
    cut = plan.select(F.col("row_key").alias("\u0001key"), *(F.col(c[1:]).alias(c) for c in steps), F.col("taken").alias("\u0001taken")).select("*", nth).where(F.col("`\u0001taken`") > 0)
    keyed = docs.select(*(F.col(f"`{c}`") for c in keep), row_key([id_col, source, text]).alias("\u0001key")).select("*", nth)
    chosen = keyed.join(cut, ["\u0001key", "\u0001nth"]).select(*(F.col(f"`{c}`") for c in [*keep, *steps]))
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            plans = zip(*(batch.column(len(keep) + i).to_pylist() for i in range(4)), strict=True)
            for row, (t, (times, lo, hi, wrap)) in enumerate(zip(utf8(batch.column(at)), plans, strict=True)):
                whole = t.decode()
                for _ in range(times):
                    rows.append(row)
                    texts.append(whole)
                spans = [(a, b) for a, b in ((0, wrap), (lo, hi)) if a < b]
                if spans:
                    rows.append(row)
                    texts.append(whole if sum(b - a for a, b in spans) == len(t.split()) else b"\n".join(_words(t, a, b) for a, b in spans).decode())
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keep)]]
            taken[at] = pa.array(texts, taken[at].type)
            yield pa.RecordBatch.from_arrays(taken, names=keep)

    return numbered(chosen).mapInArrow(run, docs.schema)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(text: bytes, first: int, after: int) -> bytes:
    """The text from its word ``first`` up to, but without, its word ``after``."""
    inside = ~_SPACE[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    return text[starts[first] : starts[after] if after < len(starts) else len(text)].rstrip(b" \t\n\v\f\r")
