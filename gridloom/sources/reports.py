"""Sinks: JSON, CSV, JUnit XML, SARIF, HTML and the trend of runs. Each takes the time of the run, so a run has one."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import kernels, metrics
from gridloom.operators.rules import Result
from gridloom.sources.graph import Graph, graph_structs

TREND_RUNS = 30
FULL = {"ignoreNullFields": "false"}
# Fixed values of the SARIF format.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
DATA_MARK = "<!-- data -->"
TEMPLATE = (
    "<!doctype html><html><head><meta charset='utf-8'><title>__TITLE__</title></head><body><h1>__TITLE__</h1><p>Generated at __TIME__, version __VERSION__</p><ul id='types'></ul><pre id='s'></pre>"
    + DATA_MARK
    + "<script>const read=id=>JSON.parse(document.getElementById(id).textContent);const graph=read('graph-data'),summary=read('summary-data'),types=read('type-data');"
    "for(const [t,n] of Object.entries(summary.modulesByType)){const x=document.createElement('li');x.textContent=(types[t]?types[t][0]:t)+': '+n;x.style.color=types[t]?types[t][1]:'';document.getElementById('types').append(x)}"
    "document.getElementById('s').textContent=JSON.stringify(summary,null,1)</script></body></html>"
)


def csv_rows(g: Graph, timestamp: str | None = None) -> DataFrame:
    """The metrics table, by path; columns in the file's order."""
    critical = kernels.critical_path(g).select("graph_id", "path").distinct().withColumn("c", F.lit(True))
    on_cycle = metrics.cycle_node_set(g).withColumn("y", F.lit(True))
    m = metrics.module_metrics(g, on_cycle).join(critical, ["graph_id", "path"], "left").join(g.modules.select("graph_id", "module_seq", "health_score"), ["graph_id", "module_seq"])
    rows = m.select(
        "graph_id", F.lit(timestamp).alias("timestamp"), F.col("path").alias("module"), "type", F.col("fan_in").alias("fanIn"), F.col("fan_out").alias("fanOut"), F.format_string("%.4f", F.col("instability").cast("double")).alias("instability"),
        F.col("transitive_count").alias("transitiveDepCount"), F.col("health_score").alias("healthScore"), F.col("is_god").alias("isGodModule"), F.coalesce("c", F.lit(False)).alias("isOnCriticalPath"), F.col("in_cycle").alias("hasCycle"),
    )
    return rows if timestamp else rows.drop("timestamp")


def write_csv(g: Graph, path: str, timestamp: str) -> None:
    csv_rows(g, timestamp).orderBy("module").drop("graph_id").coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def violation_structs(result: Result) -> DataFrame:
    v = F.struct(F.col("rule_id").alias("ruleId"), "severity", "message", "source", F.col("module_hint").alias("moduleHint"), F.col("plain_language_explanation").alias("plainLanguageExplanation"))
    return result.violations.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_seq", "seq", v.alias("v")))), lambda x: x["v"]).alias("violations"))


def _summary_struct() -> Column:
    names = {"total_modules": "totalModules", "total_edges": "totalEdges", "has_cycles": "hasCycles", "cycle_count": "cycleCount", "max_fan_out": "maxFanOut", "max_fan_in": "maxFanIn", "average_instability": "averageInstability", "critical_path_length": "criticalPathLength", "god_module_count": "godModuleCount", "isolated_module_count": "isolatedModuleCount", "modules_by_type": "modulesByType"}
    return F.struct(*(F.col(k).alias(v) for k, v in names.items()))


def json_envelope(g: Graph, result: Result, timestamp: str, version: str = "unknown") -> DataFrame:
    """``(graph_id, json)``: graph, summary and violations in the order of rules."""
    found = violation_structs(result)
    out = graph_structs(g).join(metrics.graph_summary(g).select("graph_id", _summary_struct().alias("summary")), "graph_id").join(found, "graph_id", "left")
    v = F.coalesce("violations", F.array().cast(found.schema["violations"].dataType))
    return out.select("graph_id", F.to_json(F.struct("graph", "summary", v.alias("violations"), F.lit(timestamp).alias("generatedAt"), F.lit(version).alias("version")), {**FULL, "pretty": "true"}).alias("json"))


def sarif_rows(g: Graph, result: Result) -> DataFrame:
    """Results in order: level and place of each violation."""
    module = F.coalesce("module_hint", F.split_part("source", F.lit(" "), F.lit(1)))
    v = result.violations.withColumn("module", module).join(g.lookup().select("graph_id", F.col("path").alias("module"), "build_file_path"), ["graph_id", "module"], "left")
    return v.select("graph_id", "rule_seq", "seq", "rule_id", S.lookup(S.SARIF_LEVELS, F.col("severity")).alias("level"), "message", "plain_language_explanation", "module", F.coalesce("build_file_path", F.concat(S.build_dir(F.col("module")), F.lit("/build.gradle.kts"))).alias("uri"))


def sarif(g: Graph, result: Result, version: str = "unknown", tool: str = "gridloom") -> DataFrame:
    rows = sarif_rows(g, result)
    place = F.struct(
        F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"),
        F.array(F.struct(F.col("module").alias("name"), F.lit("module").alias("kind"))).alias("logicalLocations"),
    )
    one = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    results = rows.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_seq", "seq", one.alias("x")))), lambda s: s["x"]).alias("results"))
    first = rows.groupBy("graph_id", "rule_id").agg(F.min_by(F.struct("level", F.coalesce("plain_language_explanation", "message").alias("text")), F.struct("rule_seq", "seq")).alias("f"), F.min(F.struct("rule_seq", "seq")).alias("at"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("rule_id").alias("text")).alias("shortDescription"), F.struct(F.col("f.text").alias("text")).alias("fullDescription"), F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"))
    rules = first.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", rule.alias("x")))), lambda s: s["x"]).alias("rules"))
    out = g.modules.select("graph_id").distinct().join(results, "graph_id", "left").join(rules, "graph_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), empty("rules")).alias("driver")).alias("tool"), empty("results"))
    return out.select("graph_id", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs")), {"pretty": "true"}).alias("json"))


def junit_rows(result: Result) -> DataFrame:
    """A test case for each violation; only errors fail."""
    name, source, message = (S.xml_escape(F.col(c)) for c in ("rule_id", "source", "message"))
    fail = F.concat(F.lit('<failure message="'), message, F.lit('" type="ERROR">'), message, F.lit("</failure>"))
    body = F.when(F.col("severity") == "ERROR", fail).otherwise("")
    return result.violations.select("graph_id", "rule_seq", "seq", F.concat(F.lit('<testcase name="'), name, F.lit('" classname="'), source, F.lit('">'), body, F.lit("</testcase>")).alias("testcase"))


def junit(g: Graph, result: Result, timestamp: str, project: str = "project") -> DataFrame:
    cases = junit_rows(result).groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_seq", "seq", "testcase"))), lambda s: s["testcase"]), "\n").alias("cases"))
    out = g.modules.select("graph_id").distinct().join(cases, "graph_id", "left").join(result.counts(), "graph_id", "left").fillna(0, ["error_count", "warning_count", "info_count"])
    name = S.xml_escape(F.lit(project))
    total = (F.col("error_count") + F.col("warning_count") + F.col("info_count")).cast("string")
    passed = F.concat(F.lit('<testcase name="All rules passed" classname="'), name, F.lit('"/>'))
    return out.select("graph_id", F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="Architecture check" tests="'), total, F.lit('" failures="'), F.col("error_count").cast("string"), F.lit(f'" errors="0" timestamp="{timestamp}">\n<testsuite name="'), name,
        F.lit('" tests="'), total, F.lit('" failures="'), F.col("error_count").cast("string"), F.lit('" warnings="'), F.col("warning_count").cast("string"), F.lit('">\n'), F.coalesce("cases", passed), F.lit("\n</testsuite>\n</testsuites>\n"),
    ).alias("xml"))


def adr_links(g: Graph) -> DataFrame:
    """Edges that say why they are there."""
    return g.edges.where("reason IS NOT NULL OR adr_url IS NOT NULL").select("graph_id", F.concat("src", F.lit("→"), "dst").alias("edge"), "reason", "adr_url")


def html_summary(g: Graph, result: Result, trend_json: str = "[]") -> DataFrame:
    """``(graph_id, json)``: the page's data, 24 keys."""
    fans = metrics.fan_metrics(g)
    listed = lambda df, col, name, seq: df.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, F.col(col).alias("x")))), lambda s: s["x"]).alias(name))
    edges = metrics.cycle_edges(g).withColumn("e", F.concat("src", F.lit("→"), "dst")).withColumn("at", F.struct("cycle_seq", "pos"))
    nodes = edges.groupBy("graph_id", "src").agg(F.min("at").alias("at"))
    links = adr_links(g).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("reason", F.col("adr_url").alias("adrUrl"))))).alias("adrLinks"))
    out = metrics.graph_summary(g)
    parts = [
        violation_structs(result), result.counts(), listed(kernels.critical_path(g), "path", "criticalPathModules", "pos"), listed(metrics.god_modules(fans), "path", "godModulePaths", "module_seq"),
        listed(metrics.isolated_modules(fans), "path", "isolatedModulePaths", "module_seq"), listed(nodes, "src", "mainCycleNodes", "at"), listed(edges, "e", "mainCycleEdges", "at"), links.dropDuplicates(["graph_id"]),
    ]
    for p in parts:
        out = out.join(p, "graph_id", "left")
    empty = lambda c: F.coalesce(F.col(c), (F.create_map() if c == "adrLinks" else F.array()).cast(out.schema[c].dataType)).alias(c)
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    s = _summary_struct()
    fields = [s[k].alias(k) for k in ("totalModules", "totalEdges", "hasCycles", "cycleCount", "maxFanOut", "maxFanIn", "averageInstability", "criticalPathLength", "godModuleCount", "isolatedModuleCount")]
    fields += [F.coalesce(F.col("error_count") + F.col("warning_count"), F.lit(0)).alias("violationCount"), zero("error_count", "errorCount"), zero("warning_count", "warningCount"), zero("info_count", "infoCount"), F.col("modules_by_type").alias("modulesByType")]
    fields += [empty(c) for c in ("violations", "criticalPathModules", "godModulePaths", "isolatedModulePaths", "mainCycleNodes", "mainCycleEdges")]
    trend = F.from_json(F.lit(trend_json), "array<struct<ts:long,modules:int,edges:int,cycles:int,godModules:int,critPathLen:int,avgInstability:double>>")
    fields += [trend.alias("trendEntries"), F.create_map().cast("map<string,string>").alias("teamOwners"), empty("adrLinks")]
    return out.select("graph_id", F.to_json(F.struct(*fields), FULL).alias("json"))


def html(graph_json: str, summary_json: str, title: str, template: str = TEMPLATE, timestamp: str = "", version: str = "unknown") -> str:
    """A page with its data in tags of their own, in place of the template's mark, which must be there."""
    if DATA_MARK not in template:
        raise ValueError(f"the template lacks {DATA_MARK}")
    safe = lambda s: s.replace("</", "<\\/")
    shown = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    data = {"graph-data": graph_json, "summary-data": summary_json, "type-data": json.dumps(S.TYPE_LABELS)}
    tags = "\n".join(f'<script type="application/json" id="{name}">\n{safe(text)}\n</script>' for name, text in data.items())
    head, _, rest = template.partition(DATA_MARK)
    filled = lambda s: s.replace("__TITLE__", shown).replace("__TIME__", timestamp).replace("__VERSION__", version)
    return filled(head) + tags + filled(rest)


def last_runs(trend: DataFrame, keep: int = TREND_RUNS) -> DataFrame:
    """The last runs of each graph by ``append_seq``, whatever their clocks say."""
    newest = Window.partitionBy("graph_id").orderBy(F.desc("append_seq"))
    return trend.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep).drop("rn")


def append_trend(old_json: str | None, entry: dict[str, object], keep: int = TREND_RUNS) -> str:
    """The trend file's next content; what can't be read counts as none, what is no object is dropped."""
    try:
        old = json.loads(old_json or "[]")
    except ValueError:
        old = []
    return json.dumps([*(x for x in old if isinstance(x, dict)), entry][-keep:] if isinstance(old, list) else [entry])


def trend_entry(g: Graph, ts: int, summary: DataFrame | None = None) -> DataFrame:
    """``(graph_id, entry)``: a run's line of the trend, as JSON."""
    s = metrics.graph_summary(g) if summary is None else summary
    names = {"total_modules": "modules", "total_edges": "edges", "cycle_count": "cycles", "god_module_count": "godModules", "critical_path_length": "critPathLen", "average_instability": "avgInstability"}
    return s.select("graph_id", F.to_json(F.struct(F.lit(ts).cast("long").alias("ts"), *(F.col(k).alias(v) for k, v in names.items()))).alias("entry"))


def read_trend(spark: SparkSession, folder: str) -> DataFrame:
    """``(graph_id, trend)`` from the folders that ``ReportWriter`` wrote; none where there is nothing or it can't be read."""
    try:
        return spark.read.text(folder, wholetext=True).select("graph_id", F.col("value").alias("trend"))
    except AnalysisException:
        return spark.createDataFrame([], "graph_id string, trend string")


@dataclass
class ReportWriter:
    """All sinks of one run, below one folder; each a folder by ``graph_id``. What several sinks need is computed once.

    ``metrics`` is one table of all graphs. The trend is read from ``trend`` and written to ``trend-next``, as a folder can't be read and
    overwritten at once; the caller passes the last one on.
    """

    g: Graph
    result: Result
    folder: str
    timestamp: str
    project: str = "project"
    version: str = "unknown"
    trend: str | None = None
    ts: int = 0

    def documents(self) -> dict[str, DataFrame]:
        """``(graph_id, document)`` of each sink."""
        g, result = self.g, self.result
        summary = html_summary(g, result, self.trend_json() if self.trend else "[]")
        title, time, version = self.project, self.timestamp, self.version
        page = F.udf(lambda graph, s: html(graph, s, title, timestamp=time, version=version), "string")
        both = graph_structs(g).select("graph_id", F.to_json("graph", FULL).alias("graph")).join(summary, "graph_id")
        out = {"graph.json": graph_structs(g).select("graph_id", F.to_json("graph", FULL)), "result.json": json_envelope(g, result, time, version), "result.sarif": sarif(g, result, version), "result.xml": junit(g, result, time, self.project), "index.html": both.select("graph_id", page("graph", "json"))}
        return {name: df.toDF("graph_id", "document") for name, df in out.items()}

    def trend_json(self) -> str:
        """The first graph's history, for its page."""
        row = read_trend(self.g.spark, self.trend).orderBy("graph_id").first() if self.trend else None
        return row.trend if row else "[]"

    def next_trend(self) -> DataFrame:
        """``(graph_id, document)``: each graph's history with this run."""
        old = read_trend(self.g.spark, self.trend) if self.trend else self.g.spark.createDataFrame([], "graph_id string, trend string")
        add = F.udf(lambda trend, entry: append_trend(trend, json.loads(entry)), "string")
        return trend_entry(self.g, self.ts).join(old, "graph_id", "left").select("graph_id", add("trend", "entry").alias("document"))

    def write(self) -> None:
        shared = replace(self.result, violations=self.result.violations.persist())
        writer = replace(self, g=self.g.cached(), result=shared)
        for name, df in {**writer.documents(), "trend-next": writer.next_trend()}.items():
            df.repartition("graph_id").write.mode("overwrite").option("lineSep", "\n").partitionBy("graph_id").text(f"{self.folder}/{name}")
        write_csv(writer.g, f"{self.folder}/metrics.csv", self.timestamp)
        shared.violations.unpersist()
