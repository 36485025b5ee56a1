"""Coupling, stability and health of modules, and summaries of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import kernels, reach
from gridloom.sources.graph import Graph

GOD_FAN_IN = GOD_FAN_OUT = 5


def fan_metrics(g: Graph) -> DataFrame:
    """Main edges in and out of each module, counted edge by edge, and instability out / (in + out)."""
    ends = g.main_edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("path"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("graph_id", "e.path").agg(F.sum(1 - F.col("e.o")).cast("int").alias("fan_in"), F.sum("e.o").cast("int").alias("fan_out"))
    out = g.modules.select("graph_id", "module_seq", "path", "type").join(counts, ["graph_id", "path"], "left").fillna(0, ["fan_in", "fan_out"])
    both = F.col("fan_in") + F.col("fan_out")
    return out.withColumn("instability", F.when(both == 0, 0.0).otherwise(F.col("fan_out") / F.greatest(both, F.lit(1))))


def god_modules(fans: DataFrame, fan_in: int = GOD_FAN_IN, fan_out: int = GOD_FAN_OUT) -> DataFrame:
    return fans.where((F.col("fan_in") >= fan_in) & (F.col("fan_out") >= fan_out))


def leaf_modules(fans: DataFrame) -> DataFrame:
    return fans.where("fan_out = 0")


def root_modules(fans: DataFrame) -> DataFrame:
    return fans.where("fan_in = 0")


def isolated_modules(fans: DataFrame) -> DataFrame:
    return fans.where("fan_in = 0 AND fan_out = 0")


def coupled_pairs(g: Graph, least: int = 3) -> DataFrame:
    """Pairs of modules that share dependents, each dependent once, over all edges; an equi-join on the dependent."""
    order = g.lookup().select("graph_id", "path", "module_seq")
    used = g.edges.select("graph_id", "src", F.col("dst").alias("path")).distinct().join(order, ["graph_id", "path"])
    a, b = (used.select("graph_id", "src", F.col("path").alias(f"module_{x}"), F.col("module_seq").alias(f"seq_{x}")) for x in "ab")
    shared = a.join(b, ["graph_id", "src"]).where("seq_a < seq_b").groupBy("graph_id", "module_a", "module_b").agg(F.count("*").cast("int").alias("shared"))
    if least > 0:
        return shared.where(F.col("shared") >= least)
    a, b = (order.select("graph_id", F.col("path").alias(f"module_{x}"), F.col("module_seq").alias(f"seq_{x}")) for x in "ab")
    return a.join(b, "graph_id").where("seq_a < seq_b").join(shared, ["graph_id", "module_a", "module_b"], "left").select("graph_id", "module_a", "module_b", F.coalesce("shared", F.lit(0)).alias("shared"))


def health(instability: Column, god: Column, in_cycle: Column, transitive: Column) -> Column:
    """0 to 100: what each weighs is instability 30, god module 25, cycle 25, transitive dependencies (50 or more in full) 20."""
    loss = instability * 30.0 + god.cast("double") * 25.0 + in_cycle.cast("double") * 25.0 + F.least(transitive / 50.0, F.lit(1.0)) * 20.0
    return F.greatest(F.lit(0), F.least(F.lit(100), (100.0 - loss).cast("int")))


def module_metrics(g: Graph, cycle_nodes: DataFrame | None = None) -> DataFrame:
    """Fans, instability, transitive count and health; ``cycle_nodes (graph_id, path)``: by default those of main cycles."""
    on_cycle = cycle_node_set(g) if cycle_nodes is None else cycle_nodes
    out = fan_metrics(g).join(reach.transitive_count(g).drop("module_seq"), ["graph_id", "path"])
    out = out.join(on_cycle.select("graph_id", "path").distinct().withColumn("in_cycle", F.lit(True)), ["graph_id", "path"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    god = (F.col("fan_in") >= GOD_FAN_IN) & (F.col("fan_out") >= GOD_FAN_OUT)
    return out.withColumns({"is_god": god, "health": health(F.col("instability"), god, F.col("in_cycle"), F.col("transitive_count"))})


def cycle_node_set(g: Graph, include_test: bool = False) -> DataFrame:
    return kernels.cycles(g, include_test).select("graph_id", F.explode("cycle").alias("path")).distinct()


def cycle_edges(g: Graph, include_test: bool = False) -> DataFrame:
    """Consecutive pairs of each cycle, the last back to the first."""
    c = kernels.cycles(g, include_test).select("graph_id", "cycle_seq", "cycle", F.posexplode("cycle").alias("pos", "src"))
    return c.select("graph_id", "cycle_seq", "pos", "src", F.element_at("cycle", (F.col("pos") + 1) % F.size("cycle") + 1).alias("dst"))


def modules_by_type(g: Graph) -> DataFrame:
    return g.modules.groupBy("graph_id", "type").agg(F.count("*").cast("int").alias("n"))


def graph_summary(g: Graph) -> DataFrame:
    """One row a graph; cycles are those over main edges."""
    fans = fan_metrics(g)
    base = fans.groupBy("graph_id").agg(
        F.count("*").cast("int").alias("total_modules"), F.max("fan_out").alias("max_fan_out"), F.max("fan_in").alias("max_fan_in"), F.avg("instability").alias("average_instability"),
        F.count_if((F.col("fan_in") >= GOD_FAN_IN) & (F.col("fan_out") >= GOD_FAN_OUT)).cast("int").alias("god_module_count"), F.count_if(F.col("fan_in") + F.col("fan_out") == 0).cast("int").alias("isolated_module_count"),
    )
    edges = g.edges.groupBy("graph_id").agg(F.count("*").cast("int").alias("total_edges"))
    cyc = kernels.cycles(g).groupBy("graph_id").agg(F.count("*").cast("int").alias("cycle_count"))
    crit = kernels.critical_path(g).groupBy("graph_id").agg(F.count("*").cast("int").alias("critical_path_length"))
    kinds = modules_by_type(g).groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("modules_by_type"))
    out = base
    for other in (edges, cyc, crit, kinds):
        out = out.join(other, "graph_id", "left")
    return out.fillna(0, ["total_edges", "cycle_count", "critical_path_length"]).withColumn("has_cycles", F.col("cycle_count") > 0)


def project_metrics(g: Graph) -> DataFrame:
    """Averages over modules, and whether there is a cycle over all edges."""
    agg = fan_metrics(g).groupBy("graph_id").agg(F.count("*").cast("int").alias("module_count"), F.avg("instability").alias("average_instability"), F.avg("fan_out").alias("average_fan_out"))
    return agg.join(reach.has_cycle(g), "graph_id")
