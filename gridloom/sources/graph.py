"""Graphs as DataFrames, and what they are read from.

A graph collection is two tables keyed by ``graph_id``: modules and edges, each with a sequence column, as several
operators depend on order. Edges need not point to known modules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S

MODULES = "graph_id string, module_seq int, path string, name string, type string, plugins array<string>, tags array<string>, source_sets array<string>, build_file_path string, health_score int"
EDGES = "graph_id string, edge_seq long, src string, dst string, configuration string, source_set string, declaration_line int, reason string, adr_url string"
JSON_GRAPH = (
    "projectName string, modules array<struct<path:string,name:string,type:string,plugins:array<string>,tags:array<string>,sourceSets:array<string>,buildFilePath:string,healthScore:int>>, "
    "edges array<struct<`from`:string,`to`:string,configuration:string,sourceSet:string,declarationLine:int,reason:string,adrUrl:string>>, metadata map<string,string>"
)
REQUIRED = {"modules": ("path", "name", "type"), "edges": ("from", "to", "configuration")}
KNOWN_KEYS = {"projectName", "modules", "edges", "metadata"}


@dataclass(frozen=True)
class Graph:
    modules: DataFrame
    edges: DataFrame
    info: DataFrame | None = None  # graph_id, project_name, metadata
    large: bool = False  # reachability by joins, for graphs too large for one task

    @property
    def spark(self) -> SparkSession:
        return self.modules.sparkSession

    @property
    def main_edges(self) -> DataFrame:
        return self.edges.where(~S.is_test(F.col("configuration")))

    def edge_set(self, include_test: bool) -> DataFrame:
        return self.edges if include_test else self.main_edges

    def lookup(self) -> DataFrame:
        """Modules by path; of equal paths the last holds."""
        last = Window.partitionBy("graph_id", "path").orderBy(F.desc("module_seq"))
        return self.modules.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def cached(self) -> Graph:
        return replace(self, modules=self.modules.persist(), edges=self.edges.persist())


def flagged(edges: DataFrame) -> DataFrame:
    c = F.col("configuration")
    return edges.withColumns({"is_api": S.is_api(c), "is_test": S.is_test(c), "is_compile_only": S.is_compile_only(c)})


def numbered_modules(paths: DataFrame) -> DataFrame:
    """Modules in order of path, from ``(graph_id, path, plugins, build_file_path)``."""
    p = F.col("path")
    seq = (F.row_number().over(Window.partitionBy("graph_id").orderBy("path")) - 1).cast("int")
    return paths.select(
        "graph_id", seq.alias("module_seq"), "path", S.short_name(p).alias("name"), S.detect_type(F.col("plugins")).alias("type"), F.array_distinct("plugins").alias("plugins"),
        S.path_tags(p).alias("tags"), F.array().cast("array<string>").alias("source_sets"), "build_file_path", F.lit(None).cast("int").alias("health_score"),
    )


def first_edges(edges: DataFrame) -> DataFrame:
    """Of edges with equal ends and configuration the first, numbered anew."""
    same = Window.partitionBy("graph_id", "src", "dst", "configuration").orderBy("edge_seq")
    kept = edges.withColumn("rn", F.row_number().over(same)).where("rn = 1").drop("rn")
    return kept.withColumn("edge_seq", F.row_number().over(Window.partitionBy("graph_id").orderBy("edge_seq")).cast("long") - 1)


def filter_edges(edges: DataFrame, include_test: bool = True, include_compile_only: bool = False) -> DataFrame:
    c = F.col("configuration")
    return edges.where((F.lit(include_test) | ~S.is_test(c)) & (F.lit(include_compile_only) | ~S.is_compile_only(c)))


def extract(raw: DataFrame, plugins: DataFrame, files: DataFrame | None = None, include_test: bool = True, include_compile_only: bool = False, project: str = "project", version: str = "unknown", captured_only: bool = False) -> Graph:
    """A graph from ``raw (graph_id, path, deps array<"configuration:target">)`` and ``plugins (graph_id, path, plugins)``.

    ``files (graph_id, file)``: files that exist, for the build files' paths.
    """
    paths = raw.select("graph_id", "path").distinct().join(plugins, ["graph_id", "path"], "left").withColumn("plugins", F.coalesce("plugins", F.array().cast("array<string>")))
    directory = S.build_dir(F.col("path"))
    if files is None:
        paths = paths.withColumn("build_file_path", F.lit(None).cast("string"))
    else:
        for column, name in (("kts", "build.gradle.kts"), ("groovy", "build.gradle")):
            found = files.where(F.col("file").endswith("/" + name)).select("graph_id", F.col("file").alias(column)).distinct()
            paths = paths.withColumn("want", F.concat(directory, F.lit("/" + name))).join(found.withColumnRenamed(column, "want").withColumn(column, F.col("want")), ["graph_id", "want"], "left").drop("want")
        paths = paths.withColumn("build_file_path", F.coalesce("kts", "groovy"))
    modules = numbered_modules(paths.select("graph_id", "path", "plugins", "build_file_path"))
    configuration, target = S.split_dependency(F.col("dep"))
    split = raw.select("graph_id", F.col("path").alias("src"), F.posexplode("deps").alias("pos", "dep")).select("graph_id", "src", "pos", configuration.alias("configuration"), target.alias("dst")).where("configuration is not null AND src != dst")
    if captured_only:
        split = split.where(S.is_captured(F.col("configuration")))
    ordered = filter_edges(split, include_test, include_compile_only).withColumn("edge_seq", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "pos")).cast("long"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    edges = first_edges(ordered.select("graph_id", "edge_seq", "src", "dst", "configuration", S.source_set(F.col("configuration")).alias("source_set"), none("int", "declaration_line"), none("string", "reason"), none("string", "adr_url")))
    counts = modules.groupBy("graph_id").agg(F.count("*").alias("m")).join(edges.groupBy("graph_id").agg(F.count("*").alias("e")), "graph_id", "left")
    metadata = {"moduleCount": F.col("m").cast("string"), "edgeCount": F.coalesce("e", F.lit(0)).cast("string"), "version": F.lit(version), "includeTestDependencies": F.lit(str(include_test).lower()), "includeCompileOnlyDependencies": F.lit(str(include_compile_only).lower())}
    info = counts.select("graph_id", F.lit(project).alias("project_name"), F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), v))).alias("metadata"))
    return Graph(modules, edges, info)


def extract_live(projects: DataFrame, project: str = "project", version: str = "unknown", extracted_at: str | None = None) -> Graph:
    """A graph from a build's own model: ``(graph_id, path, plugin_ids, plugins, source_sets, configurations array<struct<name, targets>>)``, nested as there.

    Only captured configurations count, and nothing else is left out but self-loops and repeats. Types go by plugin ids, source sets
    by the configuration's suffix alone, and there are no build files. A project with a null field lacks what that gives, and the rest stands.
    """
    none = F.array().cast("array<string>")
    known = projects.select("graph_id", "path", *(F.coalesce(c, none).alias(c) for c in ("plugin_ids", "plugins", "source_sets")), "configurations")
    p, kmp = F.col("path"), F.array_contains("plugin_ids", S.TYPE_BY_ID[0][1][0])
    modules = known.select(
        "graph_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("path")) - 1).cast("int").alias("module_seq"), "path", S.short_name(p).alias("name"), S.detect_type_by_id(F.col("plugin_ids")).alias("type"),
        F.array_distinct("plugins").alias("plugins"), S.path_tags(p).alias("tags"), F.when(kmp, F.array_distinct("source_sets")).otherwise(none).alias("source_sets"), F.lit(None).cast("string").alias("build_file_path"), F.lit(None).cast("int").alias("health_score"),
    )
    listed = known.select("graph_id", F.col("path").alias("src"), F.posexplode("configurations").alias("at", "c")).select("graph_id", "src", "at", F.col("c.name").alias("configuration"), F.posexplode("c.targets").alias("pos", "dst"))
    kept = listed.where(S.is_captured(F.col("configuration")) & (F.col("src") != F.col("dst")))
    kept = kept.withColumn("edge_seq", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "at", "pos")).cast("long"))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    edges = first_edges(kept.select("graph_id", "edge_seq", "src", "dst", "configuration", S.live_source_set(F.col("configuration")).alias("source_set"), nothing("int", "declaration_line"), nothing("string", "reason"), nothing("string", "adr_url")))
    metadata = {"moduleCount": F.count("*").cast("string"), "version": F.lit(version), **({"extractedAt": F.lit(extracted_at)} if extracted_at else {})}
    info = modules.groupBy("graph_id").agg(F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), v))).alias("metadata")).select("graph_id", F.lit(project).alias("project_name"), "metadata")
    return Graph(modules, edges, info)


# ----------------------------------------------------------------------- JSON
def from_json(raw: DataFrame, strict: bool = False) -> Graph:
    """Graphs from ``(graph_id, json)``. Missing fields get defaults; missing required ones, and in strict mode unknown ones, raise when rows are computed."""
    parsed = raw.select("graph_id", "json", F.from_json("json", JSON_GRAPH).alias("g"))
    lacking = lambda items, names: F.exists(items, lambda x: sum_or([x[n].isNull() for n in names]))
    bad = F.col("g").isNull() | F.col("g.projectName").isNull() | F.col("g.modules").isNull() | F.col("g.edges").isNull()
    bad = bad | lacking(F.col("g.modules"), REQUIRED["modules"]) | lacking(F.col("g.edges"), REQUIRED["edges"])
    if strict:
        bad = bad | (F.size(F.array_except(F.json_object_keys("json"), F.array(*map(F.lit, sorted(KNOWN_KEYS))))) > 0)
    ok = parsed.withColumn("g", F.when(bad, F.raise_error(F.concat(F.lit("not a graph: "), F.col("graph_id")))).otherwise(F.col("g")))
    none = F.array().cast("array<string>")
    m = ok.select("graph_id", F.posexplode("g.modules").alias("pos", "x")).select(
        "graph_id", F.col("pos").alias("module_seq"), "x.path", "x.name", "x.type", F.coalesce("x.plugins", none).alias("plugins"), F.coalesce("x.tags", none).alias("tags"),
        F.coalesce("x.sourceSets", none).alias("source_sets"), F.col("x.buildFilePath").alias("build_file_path"), F.col("x.healthScore").alias("health_score"),
    )
    e = ok.select("graph_id", F.posexplode("g.edges").alias("pos", "x")).select(
        "graph_id", F.col("pos").cast("long").alias("edge_seq"), F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.configuration", F.col("x.sourceSet").alias("source_set"),
        F.col("x.declarationLine").alias("declaration_line"), "x.reason", F.col("x.adrUrl").alias("adr_url"),
    )
    info = ok.select("graph_id", F.col("g.projectName").alias("project_name"), F.coalesce("g.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    return Graph(m, e, info)


def sum_or(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def read_json(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """A file a graph; the file's path is the id."""
    return from_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph_id"), F.col("value").alias("json")), strict)


def graph_structs(g: Graph) -> DataFrame:
    """``(graph_id, graph)``: each graph as one nested value, in the order of its sequences."""
    m = g.modules.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("module_seq", F.struct("path", "name", "type", "plugins", "tags", F.col("source_sets").alias("sourceSets"), F.col("build_file_path").alias("buildFilePath"), F.col("health_score").alias("healthScore")).alias("x")))), lambda s: s["x"]).alias("modules"))
    e = g.edges.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "configuration", F.col("source_set").alias("sourceSet"), F.col("declaration_line").alias("declarationLine"), "reason", F.col("adr_url").alias("adrUrl")).alias("x")))), lambda s: s["x"]).alias("edges"))
    info = g.info if g.info is not None else m.select("graph_id", F.lit("project").alias("project_name"), F.create_map().cast("map<string,string>").alias("metadata"))
    both = info.join(m, "graph_id", "left").join(e, "graph_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    return both.select("graph_id", F.struct(F.col("project_name").alias("projectName"), empty("modules").alias("modules"), empty("edges").alias("edges"), "metadata").alias("graph"))


def to_json(g: Graph) -> DataFrame:
    return graph_structs(g).select("graph_id", F.to_json("graph", {"ignoreNullFields": "false"}).alias("json"))


def write_json(g: Graph, folder: str) -> None:
    """A JSON file a graph, in a folder of its own named by ``graph_id``; ``read_json`` reads them."""
    to_json(g).withColumn("graph", F.col("graph_id")).select("graph", "json").repartition("graph").write.mode("overwrite").partitionBy("graph").text(folder)


def previous_cycle_count(raw: DataFrame) -> DataFrame:
    """``(graph_id, cycle_count)`` of an earlier result; null where it can't be read."""
    return raw.select("graph_id", F.expr("try_cast(get_json_object(json, '$.summary.cycleCount') AS int)").alias("cycle_count"))


def declaration_lines(files: DataFrame, targets: DataFrame) -> DataFrame:
    """First line, from 1, of each build file (``src, text``) that names a target (``src, dst``) in quotes; null if none does."""
    lines = files.select("src", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = F.ltrim(F.col("dst"), F.lit(":"))
    named = F.contains("line", F.concat(F.lit('"'), F.col("dst"), F.lit('"'))) | F.contains("line", F.concat(F.lit("':"), bare, F.lit("'")))
    found = targets.join(lines, "src").where(named).groupBy("src", "dst").agg((F.min("pos") + 1).alias("declaration_line"))
    return targets.select("src", "dst").distinct().join(found, ["src", "dst"], "left")
