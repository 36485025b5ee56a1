"""Reachability by iterated joins: for graphs too large for one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import kernels
from gridloom.sources.graph import Graph

LOCAL_SHARED = "file:///tmp/checkpoints/gridloom"
MAX_HOPS = 10_000


def _kept(df: DataFrame) -> DataFrame:
    """Computed once, lineage cut, in the folder that all executors share."""
    spark = df.sparkSession
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(folder or LOCAL_SHARED).rstrip('/')}/reach-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(graph_id, src, dst, hops)``: what each start reaches, at its fewest hops; semi-naive, a join and an anti-join a hop."""
    pairs = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    pairs = _kept(pairs)
    first = pairs if start is None else pairs.join(start.select("graph_id", F.col("path").alias("a")).distinct(), ["graph_id", "a"], "left_semi")
    delta = _kept(first.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("hops")))
    reached = delta
    for hop in range(2, MAX_HOPS):
        if delta.isEmpty():
            return reached
        step = delta.select("graph_id", "src", F.col("dst").alias("a")).join(pairs, ["graph_id", "a"]).select("graph_id", "src", F.col("b").alias("dst"), F.lit(hop).alias("hops")).distinct()
        delta = _kept(step.join(reached.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti"))
        reached = reached.unionByName(delta)
    raise RuntimeError("too many hops")


def transitive_pairs(g: Graph, include_test: bool = True, large: bool | None = None) -> DataFrame:
    """``(graph_id, src, dst)`` over known starting modules. ``large``: by joins; by default as the graph says."""
    if not (g.large if large is None else large):
        return kernels.reach_pairs(g, include_test)
    return closure(g.edge_set(include_test), g.modules).select("graph_id", "src", "dst")


def reach_count(g: Graph, pairs: DataFrame, by: str, name: str) -> DataFrame:
    counts = pairs.groupBy("graph_id", F.col(by).alias("path")).agg(F.count("*").cast("int").alias(name))
    return g.modules.select("graph_id", "module_seq", "path").join(counts, ["graph_id", "path"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def transitive_count(g: Graph, include_test: bool = True) -> DataFrame:
    return reach_count(g, transitive_pairs(g, include_test), "src", "transitive_count")


def blast_radius(g: Graph, include_test: bool = True) -> DataFrame:
    """How many modules depend on each, by any number of steps."""
    known = transitive_pairs(g, include_test).join(g.modules.select("graph_id", F.col("path").alias("src")).distinct(), ["graph_id", "src"], "left_semi")
    return reach_count(g, known, "dst", "blast_radius")


def has_cycle(g: Graph, include_test: bool = True) -> DataFrame:
    """``(graph_id, has_cycle)``: whether modules reach a cycle; self-loops are none. One walk a graph, or, if large, by peeling."""
    if not g.large:
        return kernels.per_graph(g, lambda n, e: [(kernels.closes_cycle(n, e),)] if n else [], "has_cycle boolean", include_test)
    edges = g.edge_set(include_test).where("src != dst")
    inner = _peeled(edges.select("graph_id", "src", "dst").distinct())
    starts = g.modules.select("graph_id", "path")
    met = closure(edges, starts).select("graph_id", F.col("dst").alias("path")).unionByName(starts)
    hit = inner.select("graph_id", F.col("src").alias("path")).join(met, ["graph_id", "path"], "left_semi").select("graph_id").distinct().withColumn("hit", F.lit(True))
    return g.modules.select("graph_id").distinct().join(hit, "graph_id", "left").select("graph_id", F.coalesce("hit", F.lit(False)).alias("has_cycle"))


def _peeled(edges: DataFrame) -> DataFrame:
    """What is left of edges when those into or out of an end of the graph are taken off again and again: nothing if there is no cycle."""
    left = _kept(edges)
    before, now = -1, left.count()
    while now not in (before, 0):
        ends = lambda c: left.select("graph_id", F.col(c).alias("x")).distinct()  # noqa: B023, E731
        left = _kept(left.join(ends("dst").withColumnRenamed("x", "src"), ["graph_id", "src"], "left_semi").join(ends("src").withColumnRenamed("x", "dst"), ["graph_id", "dst"], "left_semi"))
        before, now = now, left.count()
    return left


def scc_members(g: Graph, include_test: bool = False) -> DataFrame:
    """Modules on a cycle of two or more. One walk a graph, or, if large, from what peeling leaves."""
    if not g.large:
        return kernels.per_graph(g, lambda n, e: ((x,) for x in kernels.strong_members(n, e)), "path string", include_test).distinct()
    inner = _peeled(g.edge_set(include_test).where("src != dst").select("graph_id", "src", "dst").distinct())
    return closure(inner, g.modules).where("src = dst").select("graph_id", F.col("src").alias("path"))


def topo_levels(g: Graph) -> DataFrame:
    """``(graph_id, path, topo_level)``: edges of the longest chain that ends there; for graphs without cycles."""
    pairs = g.main_edges.select("graph_id", F.col("src").alias("path"), "dst").distinct().persist()
    level = g.modules.select("graph_id", "path").withColumn("topo_level", F.lit(0))
    front = level
    # A chain is no longer than its graph has nodes.
    nodes = level.select("graph_id", "path").unionByName(pairs.select("graph_id", F.col("dst").alias("path"))).distinct().groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    for hop in range(1, nodes + 1):
        front = _kept(front.join(pairs, ["graph_id", "path"]).select("graph_id", F.col("dst").alias("path"), F.lit(hop).alias("topo_level")).distinct())
        if front.isEmpty():
            pairs.unpersist()
            return level.groupBy("graph_id", "path").agg(F.max("topo_level").alias("topo_level"))
        level = level.unionByName(front)
    pairs.unpersist()
    if nodes == 0:
        return level
    raise ValueError("the graph has a cycle")


def shortest_path(g: Graph, source: str, target: str, include_test: bool = True) -> DataFrame:
    """``(graph_id, pos, path)``: fewest hops, and of those the path that comes first in the order of names."""
    pairs = g.edge_set(include_test).select("graph_id", F.col("src").alias("at"), "dst").distinct()
    near = closure(g.edge_set(include_test).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")), g.modules.where(F.col("path") == target)).select("graph_id", F.col("dst").alias("path"), "hops")
    near = near.where(F.col("path") != target).unionByName(g.modules.where(F.col("path") == target).select("graph_id", "path", F.lit(0).alias("hops")))
    at = near.where(F.col("path") == source).select("graph_id", F.col("path").alias("at"), "hops")
    out, pos = at.select("graph_id", F.lit(0).alias("pos"), F.col("at").alias("path")), 0
    first = Window.partitionBy("graph_id").orderBy("dst")
    while not at.where("hops > 0").isEmpty():
        pos += 1
        step = at.where("hops > 0").join(pairs, ["graph_id", "at"]).join(near.select("graph_id", F.col("path").alias("dst"), F.col("hops").alias("h")), ["graph_id", "dst"]).where("h = hops - 1")
        at = _kept(step.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("graph_id", F.col("dst").alias("at"), F.col("h").alias("hops")))
        out = out.unionByName(at.select("graph_id", F.lit(pos).alias("pos"), F.col("at").alias("path")))
    return out
