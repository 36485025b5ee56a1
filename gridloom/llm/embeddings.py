"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors of a label are one class with a multiplicity. Each class is hashed
in several tables by the signs of its products with seeded random hyperplanes.
What is dealt out by bucket is the class's vector in 16-bit integers, with a bound of the angle that this costs: products
of integers are exact, so every task gets the same signs of the same vector and none are sent along.
Within a bucket the cosine is taken of every pair. One that the bound does not decide is decided by the given vectors in double precision.
A pair is counted in the first table in which it meets, so links are counted
without forming a list of pairs: a bucket gives each member its number of new
links, and links that connect its members. Components are then found on those.

The bits of a table grow with the logarithm of the number of classes of the most frequent label, so buckets
keep their size, and the number of tables follows from the bits and the recall
wanted at the threshold; closer pairs are found more surely. A bucket of more than ``HOT`` members is cut into blocks, and each
pair of blocks is a task of its own, so a very common direction is spread out.

Vectors that are null, zero, or hold null or non-finite components, and vectors
with a null label or id, link with nothing: no links, their own component, kept.
Vectors of different lengths link with nothing of another length. Repeated rows
are vectors of their own, linked with one another; rows of one id with different vectors are vectors of their own, too.
Labels are compared as their strings. Only the named columns are read, whatever others are called. Empty tables give empty tables.
A class is known by a 64-bit hash of label and vector; among 10^9 classes two share one with a chance of about 0.03.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch_of, key_blocks, ready, runs, temporary, written
from gridloom.llm.components import connected_components

HOT = 4096


#: Classes of a label in a bucket, about.
BUCKET = 256
#: Largest number of a vector in integers.
SCALE = 32767
#: What rounding can do to a cosine of unit vectors.
ROUNDING = 1e-9


def table_plan(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table and number of tables: about ``BUCKET`` of so many classes in a bucket, and the recall at the threshold."""
    bits = max(4, math.ceil(math.log2(max(classes, 1) / BUCKET)))
    if bits > 30:
        raise ValueError("more classes of one label than codes of 30 bits are planned for")
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


@lru_cache(64)
def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Integers, so that products with integers are exact in double precision, in whatever order they are added."""
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables)) * 64)


def in_integers(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, each scaled to ``SCALE`` and rounded, and bounds of the angles between them and the given ones."""
    v = vectors / np.abs(vectors).max(axis=1)[:, None] * SCALE
    q = np.rint(v)
    return q.astype("<i2"), np.arcsin(np.minimum(1.0, np.linalg.norm(v - q, axis=1) / np.linalg.norm(v, axis=1))) + ROUNDING


def codes_of(q: np.ndarray, bits: int, tables: int, seed: int, first: int | None = None) -> np.ndarray:
    """Codes of vectors in integers in all tables, or in the ``first`` ones."""
    first = tables if first is None else first
    signs = q.astype(np.float64) @ planes(q.shape[1], bits, tables, seed)[:, : bits * first] > 0
    return (signs.reshape(len(q), first, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


def _with_codes(bits: int, tables: int, seed: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            q, turn, codes = ([None] * len(vectors) for _ in range(3))
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for rows in by_dim.values():
                whole, off = in_integers(np.array([vectors[i] for i in rows], float))
                for i, x, t, c in zip(rows, whole, off.tolist(), codes_of(whole, bits, tables, seed), strict=True):
                    q[i], turn[i], codes[i] = x.tobytes(), t, c.tolist()
            yield batch_of(schema, *batch.columns[:3], q, turn, codes)

    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _bucket(threshold: float, ids, mult, q, turn, codes, side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """New links of a bucket's members, links that connect them, and pairs to be decided (``links`` is -1).

    ``codes``: a function that gives rows' codes in the tables before this.
    """
    v = q.astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    wanted, widest = math.acos(threshold), 2 * float(turn.max())
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(ids)), None)
    other = first if second is None else second
    known = None
    new = np.zeros(len(ids), np.int64)
    label = np.arange(len(ids))
    for lo in range(0, len(first), 512):
        rows = first[lo : lo + 512]
        cosine = v[rows] @ v[other].T
        i, j = np.nonzero(cosine >= math.cos(min(math.pi, wanted + widest)) - ROUNDING)
        cosine = cosine[i, j]
        i, j = rows[i], other[j]
        if second is None:
            i, j, cosine = i[i < j], j[i < j], cosine[i < j]
        if len(i) and known is None:
            known = codes()
        for c in () if known is None else known.T:  # one table after the other, so that memory follows the pairs alone
            apart = c[i] != c[j]
            i, j, cosine = i[apart], j[apart], cosine[apart]
        either = turn[i] + turn[j]
        sure = cosine >= np.cos(np.maximum(0.0, wanted - either)) + ROUNDING
        open_ = ~sure & (cosine >= np.cos(np.minimum(math.pi, wanted + either)) - ROUNDING)
        if open_.any():
            yield ids[i[open_]], ids[j[open_]], np.full(int(open_.sum()), -1)
        i, j = i[sure], j[sure]
        np.add.at(new, i, mult[j])
        np.add.at(new, j, mult[i])
        while len(i):  # smallest label around, until nothing changes
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, np.concatenate((i, j, a, b)), np.concatenate((low, low, low, low)))
            label = label[label]
    hit = np.flatnonzero(new)
    yield ids[hit], ids[hit], new[hit]
    tied = np.flatnonzero(label != np.arange(len(ids)))
    yield ids[tied], ids[label[tied]], np.zeros(len(tied), np.int64)


def _search(threshold: float, bits: int, tables: int, seed: int):
    """Reads (key, table, side, id, mult, vector, turn) sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table, side, ids, mult, vectors, turn in key_blocks(batches, 0, {}, 1 << 14):
            out: list[tuple] = []
            starts, ends = runs(keys)
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                q = np.frombuffer(b"".join(vectors[lo:hi]), "<i2").reshape(hi - lo, -1)
                before = lambda: codes_of(q, bits, tables, seed, int(table[lo]))  # noqa: B023, E731
                out += _bucket(threshold, ids[lo:hi], mult[lo:hi], q, turn[lo:hi], before, side[lo:hi])
            if out:
                yield batch_of(_FOUND, *(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _decided(pairs: DataFrame, same: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose given vectors have the cosine, with both multiplicities."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    of = lambda end: same.select(F.col("node").alias(end), F.col("v").alias(f"v_{end}"), F.col("mult").alias(f"mult_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(dot("v_a", "v_b") >= threshold * F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b"))).select("a", "b", "mult_a", "mult_b")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.998, seed: int = 11, hot: int = HOT
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row."""
    ready(vectors.sparkSession)
    v = F.col("v")
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "v")))
    with temporary(vectors.sparkSession):
        same = rows.where("usable").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
        same = written(same, "vectors")
        most = same.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits, tables = table_plan(most, threshold, recall)
        hashed = same.select("node", "mult", "label", "v").mapInArrow(
            _with_codes(bits, tables, seed, pa.schema([("id", pa.int64()), ("mult", pa.int64()), ("label", pa.string()), ("vector", pa.binary()), ("turn", pa.float64()), ("codes", pa.list_(pa.int32()))])),
            "id long, mult long, label string, vector binary, turn double, codes array<int>",
        )
        hashed = written(hashed, "hashed")
        key = F.xxhash64("label", F.octet_length("vector"), "table", "code")
        size = hashed.select("label", "vector", F.posexplode("codes").alias("table", "code")).groupBy(key.alias("key")).count().where(F.col("count") > hot)
        size = written(size.select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "hot")
        posted = hashed.select("id", "mult", "label", "vector", "turn", F.posexplode("codes").alias("table", "code")).withColumn("key", key)
        columns = ("key", "table", "side", "id", "mult", "vector", "turn")
        dealt = posted.withColumn("side", F.lit(0))
        if not size.isEmpty():
            many = posted.join(size, "key").withColumn("own", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int"))
            many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            many = many.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            dealt = posted.join(size, "key", "left_anti").withColumn("side", F.lit(0)).select(*columns).unionByName(many.select(*columns))
        found = dealt.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(_search(threshold, bits, tables, seed), "a long, b long, links long")
        found = written(found, "found")
        decided = written(_decided(found.where("links < 0").select("a", "b"), same, threshold), "decided")
        component = connected_components(found.where("a != b and links = 0").select("a", "b").unionAll(decided.select("a", "b")))
        counts = found.where("a = b").select("a", "links").unionAll(decided.select("a", "mult_b")).unionAll(decided.select("b", "mult_a"))
        counted = counts.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        label_of = same.select("node", "id", "mult").join(counted, "node", "left").join(component, "node", "left")
        label_of = written(label_of.select("node", "id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component")), "labels", outer=True)
    least = label_of.groupBy("component").agg(F.min("id").alias("c"))
    out = rows.select("id", "node").join(label_of.drop("id").join(least, "component").select("node", "n", "c"), "node", "left")
    component_id = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))
