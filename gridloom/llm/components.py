"""Connected components over a distributed list of links.

Alternating large-star and small-star steps: each round ties every node's
larger neighbours, then its smaller ones, to the smallest node around it, until
the links form stars about the smallest node of each component. Every step is
an aggregate and a join on the node; each round is written to the shared
folder, so a lost executor costs no more than the round. Minima are combined
before the shuffle; the links of a hub are not shuffled to one task, as the
minima of hubs, of which there can be only so many, are broadcast.

A round has some fifteen stages, whose plans the driver holds whatever the number of links. So at most ``FEW`` links are
settled by one task instead, in memory that this bound limits; more links never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop, scratch

MAX_ROUNDS = 60

#: Distinct links up to which one task settles them, in some 100 MB.
FEW = 1 << 20

#: Nodes at most whose minimum is broadcast, about 4 MB: those with so large a share of the links that no more can have it.
HUBS = 200_000
#: Links from which on a node can be a hub.
HUB = 256


def _with_least(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u`` from ``least``, ``(u, m, n)``, whose counts ``n`` add up to ``2 * links`` at most.

    Links of hubs stay where they are and get the minimum by broadcast; the others are joined on ``u``.
    """
    hub = max(HUB, -(-2 * links // HUBS))
    of_hubs = least.where(F.col("n") >= hub).select("u", F.col("m").alias("hub_m"))
    seen = edges.join(F.broadcast(of_hubs), "u", "left")
    at_hubs = seen.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    others = seen.where("hub_m is null").select("u", "v").join(least.where(F.col("n") < hub).select("u", "m"), "u")
    return at_hubs.unionAll(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, links).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = _with_least(down, least, links).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, without the smallest of each component, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up != (further := up[up])).any():
            up = further
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def _settled(links: DataFrame) -> DataFrame:
    """``(node, component)`` of ``FEW`` links ``(u, v)`` or so, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if ends:
            found = _least_reached(*map(np.concatenate, zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", few: int | None = None) -> DataFrame:
    """``(node, component)`` for each node of a link that is not the smallest of its component.

    Links with a null end and links of a node to itself count for nothing; nodes
    that are not in the result are components of their own, or the smallest of one. ``few``: distinct links up to which one task settles them.
    """
    spark = links.sparkSession
    u, v = (F.col(c).cast("long") for c in (a, b))
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    path, before = scratch(spark, "links"), None
    edges.distinct().write.parquet(path)
    for _ in range(MAX_ROUNDS):
        edges = spark.read.schema("u long, v long").parquet(path)
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state[0] == 0 or state == before:
            break
        if before is None and state[0] <= (FEW if few is None else few):
            return _settled(edges.select("u", "v"))
        before, following = state, scratch(spark, "links")
        _small_star(_large_star(edges, state[0]), state[0]).write.parquet(following)
        drop(spark, path)
        path = following
    else:
        raise RuntimeError("components did not settle")
    return spark.read.schema("u long, v long").parquet(path).select(F.col("u").alias("node"), F.col("v").alias("component"))
