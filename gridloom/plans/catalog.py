"""Queries over the derived graph, one for each operator, and the same in SQL where SQL can say it.

Without SQL are those that depend on the order of a depth-first or first-in-first-out walk, and documents; tests hold them, over
the tables' graph, against plain recursive Python of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import insight, kernels, metrics, reach, rules
from gridloom.plans.fixtures import CTE, graph, register
from gridloom.sources import graph as sources
from gridloom.sources import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LAYERS = ("core|:core:*,:lib:*||false", "data|:feature:*:data|core|true", "presentation|:feature:*:ui,:app:*|core,data|true")
LAYER_RULE = rules.LayerRule(rules.parse_layers(LAYERS))
FEATURES = rules.FeatureIsolation(":feature:**", ((":feature:*:ui", ":feature:*:data"),))
MOST = rules.MaxTransitive(30)
TEAMS = rules.parse_teams("core-team=:core:**,:lib:**;ui-team=:feature:*:ui;data-team=:feature:*:data")
TIME = "2024-01-01T00:00:00Z"


def query(sql: str | None = None, tables: str = "mixed"):
    """Registers a query; its SQL stands after the fixture's tables, with ``e`` for the edges."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {CTE}, e AS (SELECT *, contains(lower(configuration), 'test') AS is_test FROM {tables}) {sql}" if tables else sql
        return f

    return add


def mixed(spark: SparkSession, sf: str) -> sources.Graph:
    return graph(spark, sf, "mixed")


def dag(spark: SparkSession, sf: str) -> sources.Graph:
    return graph(spark, sf, "dag")


SEGMENTS = "list_filter(string_split({0}, ':'), lambda s: trim(s) <> '')"
BARE = "replace(ltrim({0}, ':'), ':', '/')"
TYPE_SQL = "CASE WHEN path LIKE ':app:%' THEN 'ANDROID_APP' WHEN path LIKE ':feature:%:ui' THEN 'ANDROID_LIBRARY' WHEN path LIKE ':feature:%:data' THEN 'JVM_LIBRARY' WHEN path LIKE ':core:%' THEN 'KMP' WHEN path LIKE ':lib:%' THEN 'ANDROID_LIBRARY' ELSE 'UNKNOWN' END"
FILE_SQL = "CASE WHEN {0} LIKE ':legacy%' THEN NULL ELSE " + BARE + " || '/build.gradle.kts' END"
FANS = ", fans AS (SELECT module_seq, path, CAST((SELECT count(*) FROM e WHERE dst = path AND NOT is_test) AS INT) AS fan_in, CAST((SELECT count(*) FROM e WHERE src = path AND NOT is_test) AS INT) AS fan_out FROM m)"
REACH = ", r(s, t) AS (SELECT src, dst FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON r.t = e.src)"
MAIN_REACH = ", mr(s, t) AS (SELECT src, dst FROM e WHERE NOT is_test AND src <> dst UNION SELECT mr.s, e.dst FROM mr JOIN e ON mr.t = e.src WHERE NOT is_test AND src <> dst)"
TRANS = ", trans AS (SELECT path, CAST((SELECT count(*) FROM r WHERE s = path) AS INT) AS transitive_count FROM m)"
INSTABILITY = "CASE WHEN fan_in + fan_out = 0 THEN 0.0::DOUBLE ELSE fan_out::DOUBLE / (fan_in + fan_out) END"


def subject(c: str) -> str:
    return f"array_to_string(list_transform({SEGMENTS.format(c)}, lambda s: ':' || s), '')"


# What each glob means, written out by hand so that the SQL does not share the code that it checks.
GLOB_SQL = {
    "": "^$", "**:ui": "^(:[^:]+)*:ui$", ":**": "^(:[^:]+)*$", ":a.b:*": "^:a[.]b:[^:]+$", ":app:*": "^:app:[^:]+$", ":core:*": "^:core:[^:]+$", ":core:**": "^:core(:[^:]+)*$", ":core:domain": "^:core:domain$",
    ":feature:**": "^:feature(:[^:]+)*$", ":feature:*:**": "^:feature:[^:]+(:[^:]+)*$", ":feature:*:data": "^:feature:[^:]+:data$", ":feature:*:domain": "^:feature:[^:]+:domain$", ":feature:*:ui": "^:feature:[^:]+:ui$",
    ":lib:*": "^:lib:[^:]+$", ":lib:**": "^:lib(:[^:]+)*$",
}


def matches(c: str, *globs: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({subject(c)}, '{GLOB_SQL[g]}')" for g in globs) + ")"


def case_first(c: str, named) -> str:
    return "CASE " + " ".join(f"WHEN {matches(c, *globs)} THEN '{name}'" for name, globs in named) + " ELSE NULL END"


# ------------------------------------------------------------ scans and scalars
@query(f"SELECT module_seq, path, {TYPE_SQL} AS type, {FILE_SQL.format('path')} AS build_file_path FROM m")
def modules_scan(spark, sf):
    return mixed(spark, sf).modules.select("module_seq", "path", "type", "build_file_path")


@query("SELECT CAST(edge_seq AS BIGINT) AS edge_seq, src, dst, configuration FROM e")
def edges_scan(spark, sf):
    return mixed(spark, sf).edges.select("edge_seq", "src", "dst", "configuration")


@query("SELECT src, dst, configuration, configuration = 'api' AS is_api, is_test, contains(lower(configuration), 'compileonly') AS is_compile_only FROM e")
def edge_flags(spark, sf):
    return sources.flagged(mixed(spark, sf).edges).select("src", "dst", "configuration", "is_api", "is_test", "is_compile_only")


_CONFIGS = ("implementation", "latestImplementation", "debugImplementation", "testApi", "kapt", "commonMainApi", "Implementation", "iosMainCompileOnly", "annotationProcessor", "runtimeOnly", "myApiX")
_VALUES = "(VALUES " + ", ".join(f"('{c}')" for c in _CONFIGS) + ") AS v(c)"
_LIST = ", ".join(f"'{c}'" for c in S.PRODUCTION_CONFIGS + S.TEST_CONFIGS)
_STANDARD = ", ".join(f"'{c}'" for c in S.STANDARD_CONFIGS)
_SUFFIX = "(Implementation|Api|CompileOnly|RuntimeOnly)$"


@query(f"SELECT c, c IN ({_LIST}) OR regexp_matches(c, '{_SUFFIX}') AS captured FROM {_VALUES}", "")
def captured_config_filter(spark, sf):
    return spark.createDataFrame([(c,) for c in _CONFIGS], "c string").select("c", S.is_captured(F.col("c")).alias("captured"))


@query(f"SELECT c, CASE WHEN c NOT IN ({_STANDARD}) AND regexp_matches(c, '{_SUFFIX}') THEN nullif(regexp_replace(c, '{_SUFFIX}', ''), '') END AS source_set FROM {_VALUES}", "")
def source_set_name(spark, sf):
    return spark.createDataFrame([(c,) for c in _CONFIGS], "c string").select("c", S.source_set(F.col("c")).alias("source_set"))


def raw_tables(g: sources.Graph) -> tuple[DataFrame, DataFrame]:
    """The graph as a build tool would list it, each dependency twice and with a self-dependency."""
    dep = F.concat("configuration", F.lit(":"), "dst")
    lists = g.edges.groupBy("graph_id", F.col("src").alias("path")).agg(F.flatten(F.array_sort(F.collect_list(F.array(dep, dep, F.concat(F.lit("api:"), "src"), F.lit("nocolon"))))).alias("deps"))
    raw = g.modules.select("graph_id", "path").join(lists, ["graph_id", "path"], "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))
    return raw, g.modules.select("graph_id", "path", "plugins")


@query("SELECT src, dst, configuration FROM e WHERE NOT is_test AND NOT contains(lower(configuration), 'compileonly')")
def extract_flags_off(spark, sf):
    return sources.extract(*raw_tables(mixed(spark, sf)), include_test=False).edges.select("src", "dst", "configuration")


@query("SELECT src, dst, configuration, CASE configuration WHEN 'testImplementation' THEN 'test' WHEN 'commonMainImplementation' THEN 'commonMain' END AS source_set, CAST(row_number() OVER (ORDER BY src, configuration DESC, dst) - 1 AS BIGINT) AS edge_seq FROM e WHERE src IN (SELECT path FROM m)")
def extract_live_model(spark, sf):
    g = mixed(spark, sf)
    one = g.edges.groupBy("graph_id", F.col("src").alias("path"), "configuration").agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    twice = F.concat("targets", "targets", F.array("path"))
    listed = one.withColumn("c", F.explode(F.array(F.struct(F.col("configuration").alias("name"), twice.alias("targets")), F.struct(F.lit("kapt").alias("name"), F.col("targets")))))
    held = listed.groupBy("graph_id", "path").agg(F.sort_array(F.collect_list("c"), asc=False).alias("configurations"))
    projects = g.modules.select("graph_id", "path", F.array(F.lit("java")).alias("plugin_ids"), "plugins", "source_sets").join(held, ["graph_id", "path"], "left")
    return sources.extract_live(projects).edges.select("src", "dst", "configuration", "source_set", "edge_seq")


@query(f"SELECT path, {TYPE_SQL} AS type, {FILE_SQL.format('path')} AS build_file_path FROM m")
def extract_modules(spark, sf):
    g = mixed(spark, sf)
    files = g.modules.where("build_file_path is not null").select("graph_id", F.col("build_file_path").alias("file"))
    return sources.extract(*raw_tables(g), files=files).modules.select("path", "type", "build_file_path")


@query("SELECT src, dst, configuration, CAST(row_number() OVER (ORDER BY edge_seq) - 1 AS BIGINT) AS edge_seq FROM e")
def edges_dedup_first(spark, sf):
    e = mixed(spark, sf).edges
    twice = e.withColumn("edge_seq", F.col("edge_seq") * 2).unionByName(e.withColumn("edge_seq", F.col("edge_seq") * 2 + 1))
    return sources.first_edges(twice).select("src", "dst", "configuration", "edge_seq")


@query(f"SELECT path, {TYPE_SQL} AS type FROM m")
def module_type_detect(spark, sf):
    return mixed(spark, sf).modules.select("path", S.detect_type(F.col("plugins")).alias("type"))


_IDS = (("a", "org.jetbrains.kotlin.multiplatform", "KMP"), ("b", "com.android.kotlin.multiplatform.library", "KMP_ANDROID_LIBRARY"), ("c", "com.android.application", "ANDROID_APP"), ("d", "com.android.dynamic-feature", "ANDROID_LIBRARY"), ("e", "java-library", "JVM_LIBRARY"), ("f", "war", "UNKNOWN"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{t}')" for a, _, t in _IDS) + ") AS v(name, type)", "")
def module_type_by_id(spark, sf):
    return spark.createDataFrame([(a, [p, "base"]) for a, p, _ in _IDS], "name string, ids array<string>").select("name", S.detect_type_by_id(F.col("ids")).alias("type"))


@query(f"SELECT path, array_to_string(list_distinct(({SEGMENTS.format('path')})[:-2]), ',') AS tags FROM m WHERE path NOT LIKE ':feature:%' UNION ALL SELECT path, 'feature,' || string_split(path, ':')[3] FROM m WHERE path LIKE ':feature:%'")
def path_tags(spark, sf):
    return mixed(spark, sf).modules.select("path", F.array_join(S.path_tags(F.col("path")), ",").alias("tags"))


@query("SELECT path, string_split(path, ':')[-1] AS name FROM m")
def short_name(spark, sf):
    return mixed(spark, sf).modules.select("path", S.short_name(F.col("path")).alias("name"))


@query(f"SELECT path, {BARE.format('path')} AS dir FROM m")
def build_dir_path(spark, sf):
    return mixed(spark, sf).modules.select("path", S.build_dir(F.col("path")).alias("dir"))


_FILE = 'plugins {\n  id("x")\n}\ndependencies {\n  implementation(project(":core:data"))\n  api(project(":core:data"))\n  compileOnly(project(\':core:ui\'))\n}'
_TARGETS = ((":core:data", 5), (":core:ui", 7), (":core", None))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {'NULL' if n is None else n}::INT)" for p, n in _TARGETS) + ") AS v(dst, declaration_line)", "")
def declaration_line(spark, sf):
    files = spark.createDataFrame([(":app", _FILE)], "src string, text string")
    return sources.declaration_lines(files, spark.createDataFrame([(":app", p) for p, _ in _TARGETS], "src string, dst string")).select("dst", "declaration_line")


@query("SELECT src, dst, configuration FROM e WHERE src = (SELECT min(src) FROM e)")
def edges_from(spark, sf):
    e = mixed(spark, sf).edges
    return e.join(e.agg(F.min("src").alias("src")), "src").select("src", "dst", "configuration")


@query("SELECT src, dst, configuration FROM e WHERE dst = (SELECT max(dst) FROM e)")
def edges_to(spark, sf):
    e = mixed(spark, sf).edges
    return e.join(e.agg(F.max("dst").alias("dst")), "dst").select("src", "dst", "configuration")


@query(f"SELECT src, dst, {FILE_SQL.format('src')} AS build_file_path FROM e")
def module_lookup(spark, sf):
    g = mixed(spark, sf)
    return g.edges.select("src", "dst").join(g.lookup().select(F.col("path").alias("src"), "build_file_path"), "src", "left")


# -------------------------------------------------------------------- metrics
@query(f"{FANS} SELECT path, fan_in, fan_out, round({INSTABILITY}, 6) AS instability FROM fans")
def fan_metrics(spark, sf):
    return metrics.fan_metrics(mixed(spark, sf)).select("path", "fan_in", "fan_out", F.round("instability", 6).alias("instability"))


@query(f"SELECT {TYPE_SQL} AS type, CAST(count(*) AS INT) AS n FROM m GROUP BY 1")
def modules_by_type(spark, sf):
    return metrics.modules_by_type(mixed(spark, sf)).select("type", "n")


@query(f"{FANS} SELECT path FROM fans WHERE fan_in >= 5 AND fan_out >= 5")
def god_modules(spark, sf):
    return metrics.god_modules(metrics.fan_metrics(mixed(spark, sf))).select("path")


@query(f"{FANS} SELECT path FROM fans WHERE fan_out = 0")
def leaf_modules(spark, sf):
    return metrics.leaf_modules(metrics.fan_metrics(mixed(spark, sf))).select("path")


@query(f"{FANS} SELECT path FROM fans WHERE fan_in = 0")
def root_modules(spark, sf):
    return metrics.root_modules(metrics.fan_metrics(mixed(spark, sf))).select("path")


@query(f"{FANS} SELECT path FROM fans WHERE fan_in = 0 AND fan_out = 0")
def isolated_modules(spark, sf):
    return metrics.isolated_modules(metrics.fan_metrics(mixed(spark, sf))).select("path")


@query("SELECT a.path AS module_a, b.path AS module_b, CAST(count(DISTINCT x.src) AS INT) AS shared FROM m a JOIN e x ON x.dst = a.path JOIN e y ON y.src = x.src JOIN m b ON y.dst = b.path WHERE a.module_seq < b.module_seq GROUP BY 1, 2 HAVING count(DISTINCT x.src) >= 3")
def coupled_pairs(spark, sf):
    return metrics.coupled_pairs(mixed(spark, sf)).select("module_a", "module_b", "shared")


HEALTH = f"CAST(trunc(greatest(0, least(100, 100.0::DOUBLE - ({INSTABILITY} * 30.0::DOUBLE + CASE WHEN fan_in >= 5 AND fan_out >= 5 THEN 25.0::DOUBLE ELSE 0 END + CASE WHEN c THEN 25.0::DOUBLE ELSE 0 END + least(transitive_count / 50.0::DOUBLE, 1.0::DOUBLE) * 20.0::DOUBLE)))) AS INT)"
_HEALTH_FROM = f"{REACH}{MAIN_REACH}{FANS}{TRANS}, h AS (SELECT fans.path, fan_in, fan_out, transitive_count, EXISTS (SELECT 1 FROM mr WHERE s = fans.path AND t = fans.path) AS c FROM fans JOIN trans ON fans.path = trans.path)"


@query(f"{_HEALTH_FROM} SELECT path, {HEALTH} AS health FROM h")
def health_score(spark, sf):
    g = mixed(spark, sf)
    return metrics.module_metrics(g, reach.scc_members(g)).select("path", "health")


@query()
def health_score_dfs(spark, sf):
    return metrics.module_metrics(mixed(spark, sf)).select("path", "health")


@query(f"{_HEALTH_FROM} SELECT path, fan_in, fan_out, round({INSTABILITY}, 6) AS instability, transitive_count, c AS in_cycle, fan_in >= 5 AND fan_out >= 5 AS is_god FROM h")
def module_metrics(spark, sf):
    g = mixed(spark, sf)
    return metrics.module_metrics(g, reach.scc_members(g)).select("path", "fan_in", "fan_out", F.round("instability", 6).alias("instability"), "transitive_count", "in_cycle", "is_god")


_ANY_CYCLE = ", cyc AS (SELECT EXISTS (SELECT 1 FROM nr WHERE s = t) AS has_cycle)"
_NO_SELF = ", nr(s, t) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT nr.s, e.dst FROM nr JOIN e ON nr.t = e.src WHERE src <> dst)"


@query(f"{_NO_SELF}{_ANY_CYCLE}{FANS} SELECT CAST(count(*) AS INT) AS module_count, round(avg({INSTABILITY}), 6) AS average_instability, round(avg(fan_out), 6) AS average_fan_out, (SELECT has_cycle FROM cyc) AS has_cycle FROM fans")
def project_metrics(spark, sf):
    return metrics.project_metrics(mixed(spark, sf)).select("module_count", F.round("average_instability", 6).alias("average_instability"), F.round("average_fan_out", 6).alias("average_fan_out"), "has_cycle")


LEVELS = ", lv(p, d) AS (SELECT path, 0 FROM m UNION SELECT e.dst, d + 1 FROM lv JOIN e ON e.src = lv.p WHERE NOT is_test)"


@query(f"{FANS}{LEVELS} SELECT CAST(count(*) AS INT) AS total_modules, CAST((SELECT count(*) FROM e) AS INT) AS total_edges, false AS has_cycles, 0 AS cycle_count, max(fan_out) AS max_fan_out, max(fan_in) AS max_fan_in, round(avg({INSTABILITY}), 6) AS average_instability, CAST((SELECT max(d) + 1 FROM lv) AS INT) AS critical_path_length, CAST(count(*) FILTER (fan_in >= 5 AND fan_out >= 5) AS INT) AS god_module_count, CAST(count(*) FILTER (fan_in = 0 AND fan_out = 0) AS INT) AS isolated_module_count FROM fans", "dag")
def graph_summary(spark, sf):
    return _summary(dag(spark, sf))


def _summary(g):
    return metrics.graph_summary(g).select("total_modules", "total_edges", "has_cycles", "cycle_count", "max_fan_out", "max_fan_in", F.round("average_instability", 6).alias("average_instability"), "critical_path_length", "god_module_count", "isolated_module_count")


@query()
def graph_summary_mixed(spark, sf):
    return _summary(mixed(spark, sf))


# --------------------------------------------------------------- reachability
@query(f"{REACH} SELECT s AS src, t AS dst FROM r")
def transitive_pairs(spark, sf):
    return reach.transitive_pairs(mixed(spark, sf)).select("src", "dst")


@query(f"{REACH} SELECT s AS src, t AS dst FROM r")
def transitive_pairs_by_joins(spark, sf):
    return reach.transitive_pairs(mixed(spark, sf), large=True).select("src", "dst")


@query(f"{REACH}{TRANS} SELECT path, transitive_count FROM trans")
def transitive_count(spark, sf):
    return reach.transitive_count(mixed(spark, sf)).select("path", "transitive_count")


@query(f"{REACH} SELECT path, CAST((SELECT count(*) FROM r WHERE t = path) AS INT) AS blast_radius FROM m")
def blast_radius(spark, sf):
    return reach.blast_radius(mixed(spark, sf)).select("path", "blast_radius")


@query(f"{_NO_SELF}{_ANY_CYCLE} SELECT has_cycle FROM cyc")
def has_cycle_all(spark, sf):
    return reach.has_cycle(mixed(spark, sf)).select("has_cycle")


@query(f"{_NO_SELF}{_ANY_CYCLE} SELECT has_cycle FROM cyc", "dag")
def has_cycle_main(spark, sf):
    return reach.has_cycle(dag(spark, sf), include_test=False).select("has_cycle")


@query(f"{MAIN_REACH} SELECT s AS path FROM mr WHERE s = t")
def scc_members(spark, sf):
    return reach.scc_members(mixed(spark, sf)).select("path")


@query(f"{LEVELS} SELECT p AS path, max(d) AS topo_level FROM lv GROUP BY p", "dag")
def topo_level(spark, sf):
    return reach.topo_levels(dag(spark, sf)).select("path", "topo_level")


@query(f"{LEVELS} SELECT max(d) + 1 AS length FROM lv", "dag")
def critical_path_length(spark, sf):
    return kernels.critical_path(dag(spark, sf)).agg(F.count("*").cast("int").alias("length"))


_PART_EDGES = "(SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


@query(f"WITH RECURSIVE pe AS {_PART_EDGES}, r(t) AS (SELECT dst FROM pe WHERE src = (SELECT min(src) FROM pe) UNION SELECT pe.dst FROM r JOIN pe ON r.t = pe.src) SELECT count(*) AS reached FROM r", "")
def part_reach_from_one(spark, sf):
    """Single-source reach over the larger graph of parts that follow one another in orders."""
    register(spark, sf, ("lineitem",))
    e = spark.sql(f"SELECT 'p' AS graph_id, CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst FROM {_PART_EDGES} x")
    start = e.agg(F.min(F.col("src").cast("long")).cast("string").alias("path")).withColumn("graph_id", F.lit("p"))
    return reach.closure(e, start).agg(F.count("*").alias("reached"))



_FIRST_APP = "(SELECT min(src) FROM e WHERE src LIKE ':app:%')"
_WALK = f", w(here, trail, hops) AS (SELECT {_FIRST_APP}, {_FIRST_APP}, 0 UNION ALL SELECT e2.dst, trail || ' > ' || e2.dst, hops + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM e) e2 ON e2.src = w.here WHERE hops < 8 AND w.here NOT LIKE ':core:%')"


@query(f"{_WALK}, best AS (SELECT trail FROM w WHERE here = (SELECT min(c.dst) FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src = {_FIRST_APP} AND c.dst LIKE ':core:%') ORDER BY hops, trail LIMIT 1) SELECT trail FROM best", "dag")
def shortest_path(spark, sf):
    g = dag(spark, sf)
    start = g.edges.where("src LIKE ':app:%'").agg(F.min("src")).first()[0]
    hop = lambda at: g.edges.join(at.select(F.col("dst").alias("src")), "src")
    end = hop(hop(g.edges.where(F.col("src") == start))).where("dst LIKE ':core:%'").agg(F.min("dst")).first()[0]
    steps = reach.shortest_path(g, start, end)
    return steps.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda s: s["path"]), " > ").alias("trail")).select("trail")


# -------------------------------------------------------------------- kernels
@query()
def cycles_all(spark, sf):
    return kernels.cycles(mixed(spark, sf), include_test=True).select("cycle_seq", F.array_join("cycle", " > ").alias("cycle"))


@query()
def cycles_main(spark, sf):
    return kernels.cycles(mixed(spark, sf)).select("cycle_seq", F.array_join("cycle", " > ").alias("cycle"))


@query()
def cycles_dedup(spark, sf):
    return kernels.cycles(mixed(spark, sf), dedupe=True).select("cycle_seq", F.array_join("cycle", " > ").alias("cycle"))


@query()
def cycle_edges(spark, sf):
    return metrics.cycle_edges(mixed(spark, sf)).select("cycle_seq", "pos", "src", "dst")


@query()
def topo_order(spark, sf):
    return kernels.topo_order(dag(spark, sf)).select("topo_pos", "path")


@query()
def critical_path(spark, sf):
    return kernels.critical_path(dag(spark, sf)).select("pos", "path")


# ---------------------------------------------------------------------- rules
GLOBS = (":core:domain", ":feature:*:domain", ":core:*", ":feature:**", ":**", ":feature:*:**", "**:ui", "", ":a.b:*")
PATHS = (":core:domain", ":core:data", ":app", ":feature:login:domain", ":feature:login:sub:domain", ":feature:domain", ":core:domain:model", ":feature:login", ":feature", ":feature:login:ui:extra", ":feature:x:ui", "", ":a.b:c", ":axb:c")


@query("SELECT pattern, path, CASE " + " ".join(f"WHEN pattern = '{g}' THEN {matches('path', g)}" for g in GLOBS) + " END AS matched FROM (VALUES " + ", ".join(f"('{g}')" for g in GLOBS) + ") AS g(pattern), (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") AS p(path)", "")
def glob_truth_table(spark, sf):
    df = spark.createDataFrame([(g, p) for g in GLOBS for p in PATHS], "pattern string, path string")
    out = F.lit(None).cast("boolean")
    for g in GLOBS:
        out = F.when(F.col("pattern") == g, S.glob_match(F.col("path"), g)).otherwise(out)
    return df.select("pattern", "path", out.alias("matched"))


_NAMED = [(x.name, x.patterns) for x in LAYER_RULE.layers]


@query(f"SELECT path, {case_first('path', _NAMED)} AS layer FROM m")
def layer_assignment(spark, sf):
    return mixed(spark, sf).modules.select("path", S.first_match(F.col("path"), _NAMED).alias("layer"))


_LAYERED = f", le AS (SELECT edge_seq, src, dst, {case_first('src', _NAMED)} AS a, {case_first('dst', _NAMED)} AS b FROM e WHERE NOT is_test AND src IN (SELECT path FROM m) AND dst IN (SELECT path FROM m))"
_OK = "(a = b OR a = 'core' OR (a = 'data' AND b = 'core') OR (a = 'presentation' AND b IN ('core', 'data')))"
_DECLARED = "coalesce(' [declared in ' || " + FILE_SQL.format("src") + " || ']', '')"


@query(f"{_LAYERED} SELECT 'layer-dependency' AS rule_id, 'ERROR' AS severity, 'Layer ' || a || ' must not use layer ' || b || ': ' || src || ' → ' || dst || '. It may use: ' || CASE a WHEN 'data' THEN 'core' ELSE 'core, data' END || {_DECLARED} AS message, src || ' → ' || dst AS source, src AS module_hint FROM le WHERE a IS NOT NULL AND b IS NOT NULL AND NOT {_OK}")
def layer_violations(spark, sf):
    return LAYER_RULE.evaluate(mixed(spark, sf)).select("rule_id", "severity", "message", "source", "module_hint")


_FEATURE_BAD = f"FROM e WHERE NOT is_test AND src LIKE ':feature:%' AND dst LIKE ':feature:%' AND dst IN (SELECT path FROM m) AND NOT ({matches('src', ':feature:*:ui')} AND {matches('dst', ':feature:*:data')})"


@query(f"SELECT 'no-feature-to-feature' AS rule_id, 'ERROR' AS severity, 'Feature ' || src || ' uses feature ' || dst || {_DECLARED} AS message, src || ' → ' || dst AS source, src AS module_hint {_FEATURE_BAD}")
def feature_violations(spark, sf):
    return FEATURES.evaluate(mixed(spark, sf)).select("rule_id", "severity", "message", "source", "module_hint")


@query(f"{REACH}{TRANS} SELECT 'max-transitive-dependencies' AS rule_id, 'WARNING' AS severity, path || ' reaches ' || transitive_count || ' modules, more than 30' || coalesce(' [declared in ' || {FILE_SQL.format('path')} || ']', '') AS message, path AS source FROM trans WHERE transitive_count > 30")
def max_transitive_violations(spark, sf):
    return MOST.evaluate(mixed(spark, sf)).select("rule_id", "severity", "message", "source")


def _found(df):
    return df.select("seq", "rule_id", "severity", "message", "source", "module_hint")


@query()
def cycle_violations(spark, sf):
    return _found(rules.NoCycles().evaluate(mixed(spark, sf)).where("rule_id = 'no-cyclic-dependencies'"))


@query()
def test_cycle_violations(spark, sf):
    return _found(rules.NoCycles().evaluate(mixed(spark, sf)).where("severity = 'INFO'"))


@query()
def cycle_regression(spark, sf):
    return _found(rules.NoCycles(True, 0).evaluate(mixed(spark, sf)).where("source = 'cycle-regression'"))


_BOTH = f"{_LAYERED}, found AS (SELECT 'layer-dependency' AS rule_id, src, dst FROM le WHERE a IS NOT NULL AND b IS NOT NULL AND NOT {_OK} UNION ALL SELECT 'no-feature-to-feature', src, dst {_FEATURE_BAD})"


@query(f"{_BOTH} SELECT rule_id, CASE rule_id WHEN 'layer-dependency' THEN 'WARNING' ELSE 'ERROR' END AS severity, src || ' → ' || dst AS source FROM found")
def severity_override(spark, sf):
    engine = rules.Engine([LAYER_RULE, FEATURES], rules.parse_overrides(["layer-dependency:severity:WARNING", "no-feature-to-feature:severity:LOUD"]))
    return engine.evaluate(mixed(spark, sf), isolate=False).violations.select("rule_id", "severity", "source")


@query(f"{_BOTH} SELECT rule_id, src || ' → ' || dst AS source FROM found WHERE NOT (rule_id = 'no-feature-to-feature' AND {matches('src', ':feature:*:ui')})")
def suppression(spark, sf):
    engine = rules.Engine([LAYER_RULE, FEATURES], rules.parse_overrides(["no-feature-to-feature:suppress::feature:*:ui"]))
    return engine.evaluate(mixed(spark, sf), isolate=False).violations.select("rule_id", "source")


@query(f"{_BOTH} SELECT CAST(count(*) FILTER (rule_id = 'no-feature-to-feature') AS INT) AS error_count, CAST(count(*) FILTER (rule_id = 'layer-dependency') AS INT) AS warning_count, 0 AS info_count, count(*) FILTER (rule_id = 'no-feature-to-feature') > 0 AS has_build_failure FROM found")
def rule_result_counts(spark, sf):
    engine = rules.Engine([LAYER_RULE, FEATURES], rules.Config({"layer-dependency": "WARNING"}))
    return engine.evaluate(mixed(spark, sf), isolate=False).counts().drop("graph_id")


@query(f"{_BOTH} SELECT rule_id, CAST(count(*) AS INT) AS n, 'ERROR' AS severity FROM found GROUP BY rule_id")
def violations_by_rule(spark, sf):
    return rules.Engine([LAYER_RULE, FEATURES]).evaluate(mixed(spark, sf), isolate=False).by_rule().select("rule_id", "n", "severity")


# -------------------------------------------------------------------- reports
@query(f"{REACH}{FANS}{TRANS} SELECT fans.path AS module, {TYPE_SQL.replace('path', 'fans.path')} AS type, fan_in AS \"fanIn\", fan_out AS \"fanOut\", printf('%.4f', {INSTABILITY}) AS instability, transitive_count AS \"transitiveDepCount\", NULL::INT AS \"healthScore\", fan_in >= 5 AND fan_out >= 5 AS \"isGodModule\", false AS \"hasCycle\" FROM fans JOIN trans ON fans.path = trans.path", "dag")
def csv_metrics(spark, sf):
    return reports.csv_rows(dag(spark, sf)).drop("graph_id", "isOnCriticalPath")


@query("SELECT src || '→' || dst AS edge, 'exports ' || dst AS reason, NULL::VARCHAR AS adr_url FROM e WHERE configuration = 'api'", "dag")
def adr_links(spark, sf):
    return reports.adr_links(dag(spark, sf)).drop("graph_id")


_FEATURE_MESSAGE = "'Feature ' || src || ' uses feature ' || dst || " + _DECLARED


@query(f"SELECT 'no-feature-to-feature' AS rule_id, 'error' AS level, {_FEATURE_MESSAGE} AS message, src AS module, {BARE.format('src')} || '/build.gradle.kts' AS uri {_FEATURE_BAD}", "dag")
def sarif_rows(spark, sf):
    g = dag(spark, sf)
    return reports.sarif_rows(g, rules.Engine([FEATURES]).evaluate(g, isolate=False)).select("rule_id", "level", "message", "module", "uri")


@query(f"SELECT '<testcase name=\"no-feature-to-feature\" classname=\"' || src || ' → ' || dst || '\"><failure message=\"' || {_FEATURE_MESSAGE} || '\" type=\"ERROR\">' || {_FEATURE_MESSAGE} || '</failure></testcase>' AS testcase {_FEATURE_BAD}", "dag")
def junit_rows(spark, sf):
    return reports.junit_rows(rules.Engine([FEATURES]).evaluate(dag(spark, sf), isolate=False)).select("testcase")


def _all_rules(g):
    return rules.Engine.from_config(LAYERS, ":feature:**", [":feature:*:ui->:feature:*:data"], ["max-transitive-dependencies:threshold:30"]).evaluate(g, isolate=False)


@query()
def json_envelope(spark, sf):
    g = mixed(spark, sf)
    return reports.json_envelope(g, _all_rules(g), TIME)


@query()
def sarif_report(spark, sf):
    g = mixed(spark, sf)
    return reports.sarif(g, _all_rules(g))


@query()
def junit_report(spark, sf):
    g = mixed(spark, sf)
    return reports.junit(g, _all_rules(g), TIME)


@query()
def html_summary(spark, sf):
    g = mixed(spark, sf)
    return reports.html_summary(g, _all_rules(g))


@query("SELECT d AS day, modules, edges FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, CAST(count(DISTINCT user_id) AS INT) AS modules, CAST(count(*) AS INT) AS edges FROM events GROUP BY 1) x ORDER BY d DESC LIMIT 30", "")
def trend_last_30(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").cast("int").alias("modules"), F.count("*").cast("int").alias("edges"))
    return reports.last_runs(runs.withColumn("graph_id", F.lit("g")).withColumn("append_seq", F.datediff("day", F.lit("1970-01-01")))).select("day", "modules", "edges")


# ------------------------------------------------------------------- insights
@query(f"SELECT path, {case_first('path', TEAMS)} AS team FROM m")
def team_owner(spark, sf):
    return insight.team_owners(mixed(spark, sf), TEAMS).select("path", "team")


@query(f"SELECT * FROM (SELECT src, dst, configuration, {case_first('src', TEAMS)} AS src_team, {case_first('dst', TEAMS)} AS dst_team FROM e WHERE NOT is_test) x WHERE src_team <> dst_team")
def cross_team_edges(spark, sf):
    return insight.cross_team_edges(mixed(spark, sf), TEAMS).drop("graph_id")


@query(f"{_LAYERED} SELECT a AS layer, CAST(count(*) AS INT) AS edges, round(avg(CASE WHEN {_OK} THEN 1 ELSE 0 END) * 100, 6) AS purity FROM le WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY a")
def layer_purity(spark, sf):
    return insight.layer_purity(mixed(spark, sf), LAYER_RULE).select("layer", "edges", F.round("purity", 6).alias("purity"))


@query("SELECT e.src, e.dst, a.module_seq AS row_pos, b.module_seq AS col_pos, CAST(count(*) AS INT) AS n, a.module_seq > b.module_seq AS below FROM e JOIN m a ON e.src = a.path JOIN m b ON e.dst = b.path WHERE NOT is_test GROUP BY ALL")
def adjacency_matrix(spark, sf):
    return insight.adjacency_matrix(mixed(spark, sf)).drop("graph_id")


@query("SELECT 'edge' AS kind, src || ' > ' || dst || ' : ' || configuration AS item, 'removed' AS change FROM e WHERE src || ' ' || dst || ' ' || configuration NOT IN (SELECT src || ' ' || dst || ' ' || configuration FROM dag)")
def graph_diff(spark, sf):
    return insight.graph_diff(mixed(spark, sf), dag(spark, sf)).drop("graph_id")


_MISSING = "SELECT src || ' > ' || dst || ' : ' || configuration AS item FROM e WHERE src || ' ' || dst || ' ' || configuration NOT IN (SELECT src || ' ' || dst || ' ' || configuration FROM dag)"


@query(f", x AS ({_MISSING}) SELECT 'a' AS graph_id, 'edge' AS kind, item, 'removed' AS change FROM x UNION ALL SELECT 'b', 'edge', item, 'added' FROM x")
def graph_diff_by_graph(spark, sf):
    """Two graphs change places: what one loses the other gains."""
    big, small = mixed(spark, sf), dag(spark, sf)
    named = lambda g, name: (g.modules.withColumn("graph_id", F.lit(name)), g.edges.withColumn("graph_id", F.lit(name)))
    both = lambda a, b: sources.Graph(*(x.unionByName(y) for x, y in zip(named(a, "a"), named(b, "b"), strict=True)))
    return insight.graph_diff(both(big, small), both(small, big))


@query("SELECT path, direction, scope, other, configuration FROM (SELECT src AS path, 'out' AS direction, dst AS other, configuration FROM e UNION ALL SELECT dst, 'in', src, configuration FROM e) x JOIN (VALUES ('implementation', 'implementation'), ('api', 'api'), ('compileOnly', 'compile_only'), ('testImplementation', 'test'), ('commonMainImplementation', 'implementation')) AS s(c, scope) ON configuration = c")
def dependencies_by_scope(spark, sf):
    return insight.dependencies_by_scope(mixed(spark, sf)).drop("graph_id")


@query(f"{FANS} SELECT path, CAST(row_number() OVER (ORDER BY fan_in + fan_out DESC, path) - 1 AS INT) AS pos FROM fans")
def matrix_order_by_connectivity(spark, sf):
    return insight.matrix_order(mixed(spark, sf), "connectivity").select("path", "pos")


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY {TYPE_SQL}, path) - 1 AS INT) AS pos FROM m")
def matrix_order_by_type(spark, sf):
    return insight.matrix_order(mixed(spark, sf), "type").select("path", "pos")


@query(f"SELECT prefix, CAST(count(*) AS INT) AS modules, CAST(len(string_split(prefix, ':')) - 1 AS INT) AS depth FROM (SELECT ':' || array_to_string(s[1:i], ':') AS prefix FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {SEGMENTS.format('path')} AS s FROM m) x) y) z GROUP BY prefix")
def module_tree(spark, sf):
    return insight.module_tree(mixed(spark, sf)).select("prefix", "modules", "depth")


@query("SELECT CASE WHEN path LIKE '%:ui' THEN 'presentation' ELSE 'data' END AS layer, CAST(count(*) AS INT) AS modules FROM m WHERE path LIKE ':feature:%' GROUP BY 1")
def suggested_layers(spark, sf):
    return insight.suggested_layers(mixed(spark, sf)).select("layer", "modules")


@query()
def edge_kinds(spark, sf):
    g = mixed(spark, sf)
    return insight.edge_kinds(g, metrics.cycle_edges(g)).drop("graph_id")


@query("SELECT path FROM m WHERE contains(lower(path), 'core')")
def module_search(spark, sf):
    return insight.search(mixed(spark, sf), "CORE").select("path")


