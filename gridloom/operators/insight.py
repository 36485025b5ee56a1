"""Views of graphs that people look at: differences, matrices, layers, teams, trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import kernels, metrics
from gridloom.operators.rules import LayerRule
from gridloom.sources.graph import Graph, flagged


def graph_diff(old: Graph, new: Graph) -> DataFrame:
    """Modules and edges (``graph_id``, ``kind``, ``item``) that were ``added`` to a graph or ``removed`` from it."""

    def items(g: Graph) -> DataFrame:
        e = g.edges.select("graph_id", F.lit("edge").alias("kind"), F.concat("src", F.lit(" > "), "dst", F.lit(" : "), "configuration").alias("item"))
        return g.modules.select("graph_id", F.lit("module").alias("kind"), F.col("path").alias("item")).unionByName(e).distinct()

    a, b, on = items(old), items(new), ["graph_id", "kind", "item"]
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


ORDERS = ("name", "connectivity", "topology", "type")


def matrix_order(g: Graph, by: str) -> DataFrame:
    """Places of modules, ties by name: by name, by main edges in and out (most first), by topological order (by name where a cycle allows none), or by type."""
    if by not in ORDERS:
        raise ValueError(f"no such order: {by}")
    at = metrics.fan_metrics(g)
    if by == "topology":
        order = kernels.per_graph(g, lambda n, e: enumerate(kernels.topological_order(n, e) or ()), "topo_pos int, path string", False)
        at = at.join(order, ["graph_id", "path"], "left")
    key = {"name": F.lit(0), "connectivity": -(F.col("fan_in") + F.col("fan_out")), "topology": F.col("topo_pos") if by == "topology" else F.lit(0), "type": F.col("type")}[by]
    return at.select("graph_id", "path", (F.row_number().over(Window.partitionBy("graph_id").orderBy(key, "path")) - 1).cast("int").alias("pos"))


def adjacency_matrix(g: Graph, order: DataFrame | str | None = None) -> DataFrame:
    """Cells with main edges; ``order (graph_id, path, pos)`` or one of ``ORDERS``, by default by name. ``below``: under the diagonal."""
    if isinstance(order, str):
        order = matrix_order(g, order)
    if order is None:
        order = g.modules.select("graph_id", "path", (F.row_number().over(Window.partitionBy("graph_id").orderBy("path")) - 1).cast("int").alias("pos"))
    cells = g.main_edges.groupBy("graph_id", "src", "dst").agg(F.count("*").cast("int").alias("n"))
    for end, name in (("src", "row_pos"), ("dst", "col_pos")):
        cells = cells.join(order.select("graph_id", F.col("path").alias(end), F.col("pos").alias(name)), ["graph_id", end])
    return cells.withColumn("below", F.col("row_pos") > F.col("col_pos"))


def layer_purity(g: Graph, rule: LayerRule) -> DataFrame:
    """Of the main edges that leave a layer for another, the percentage that is allowed."""
    out = rule.edges(g).where("from_layer != to_layer").groupBy("graph_id", F.col("from_layer").alias("layer"))
    return out.agg(F.count("*").cast("int").alias("edges"), (F.avg(F.col("allowed").cast("int")) * 100).alias("purity"))


def team_owners(g: Graph, teams: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    return g.modules.select("graph_id", "path", S.first_match(F.col("path"), teams).alias("team"))


def cross_team_edges(g: Graph, teams: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    e = g.main_edges.select("graph_id", "src", "dst", "configuration", S.first_match(F.col("src"), teams).alias("src_team"), S.first_match(F.col("dst"), teams).alias("dst_team"))
    return e.where("src_team != dst_team")


def module_tree(g: Graph) -> DataFrame:
    """How many modules stand under each prefix of a path."""
    s = F.col("s")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.concat(F.lit(":"), F.array_join(F.slice(s, 1, i), ":")))
    each = g.modules.select("graph_id", S.segments(F.col("path")).alias("s")).where("size(s) > 0").select("graph_id", F.explode(prefixes).alias("prefix"))
    return each.groupBy("graph_id", "prefix").agg(F.count("*").cast("int").alias("modules")).withColumn("depth", F.size(F.split("prefix", ":")) - 1)


def edge_kinds(g: Graph, cycle_edges: DataFrame) -> DataFrame:
    """Each edge's filter: main cycle, test cycle, test, compile-only, API, source set or plain.

    ``cycle_edges``: of main cycles. Test edges whose ends a cycle over all edges joins are ``test_cycle``.
    """
    every = metrics.cycle_edges(g, include_test=True).select("graph_id", "src", "dst").distinct().withColumn("on_any", F.lit(True))
    on = cycle_edges.select("graph_id", "src", "dst").distinct().withColumn("on_cycle", F.lit(True))
    e = flagged(g.edges).join(on, ["graph_id", "src", "dst"], "left").join(every, ["graph_id", "src", "dst"], "left")
    kind = F.when(F.col("on_cycle") & ~F.col("is_test"), "main_cycle").when(F.col("on_any") & F.col("is_test"), "test_cycle").when(F.col("is_test"), "test").when(F.col("is_compile_only"), "compile_only").when(F.col("is_api"), "api").when(F.col("source_set").isNotNull(), "source_set").otherwise("implementation")
    return e.select("graph_id", "edge_seq", "src", "dst", "configuration", kind.alias("kind"))


def dependencies_by_scope(g: Graph) -> DataFrame:
    """Rows of a module's tables: what it uses (``direction`` is ``out``) and what uses it (``in``), by the edge's scope."""
    scope = F.when(F.col("is_test"), "test").when(F.col("is_compile_only"), "compile_only").when(F.col("is_api"), "api").otherwise("implementation")
    e = flagged(g.edges).select("graph_id", "src", "dst", "configuration", scope.alias("scope"))
    out = e.select("graph_id", F.col("src").alias("path"), F.lit("out").alias("direction"), "scope", F.col("dst").alias("other"), "configuration")
    return out.unionByName(e.select("graph_id", F.col("dst").alias("path"), F.lit("in").alias("direction"), "scope", F.col("src").alias("other"), "configuration"))


def suggested_layers(g: Graph) -> DataFrame:
    """Modules by a layer's usual name as a whole segment of their path."""
    out = F.lit(None).cast("string")
    for layer in ("presentation", "ui", "data", "domain"):
        out = F.when(F.array_contains(S.segments(F.col("path")), layer), "presentation" if layer == "ui" else layer).otherwise(out)
    return g.modules.withColumn("layer", out).where("layer IS NOT NULL").groupBy("graph_id", "layer").agg(F.count("*").cast("int").alias("modules"))


def search(g: Graph, text: str) -> DataFrame:
    return g.modules.where(F.contains(F.lower("path"), F.lit(text.lower())))
