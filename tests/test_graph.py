"""Operators on small graphs with known results, and against plain Python on random ones."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import insight, kernels, metrics, reach, rules
from gridloom.sources import graph as sources
from gridloom.sources import reports
from gridloom.sources.graph import EDGES, MODULES, Graph


def build(spark, **graphs):
    """Graphs of ``(nodes, edges)``; an edge is ``a>b`` or ``a>b:configuration``."""
    m, e = [], []
    for name, (nodes, edges) in graphs.items():
        m += [(name, i, n, n.rpartition(":")[2], "UNKNOWN", [], [], [], f"{n.strip(':').replace(':', '/')}/build.gradle.kts", None) for i, n in enumerate(nodes)]
        for i, x in enumerate(edges):
            a, _, b = x.partition(">")
            b, _, c = b.partition("@")
            e.append((name, i, a, b, c or "implementation", None, None, None, None))
    return Graph(spark.createDataFrame(m, MODULES), spark.createDataFrame(e, EDGES))


REALISTIC = ([":app", ":feature:login", ":feature:home", ":core:domain", ":core:data"], [":app>:feature:login", ":app>:feature:home", ":feature:login>:core:domain", ":feature:home>:core:domain", ":feature:home>:core:data", ":core:data>:core:domain"])


@pytest.fixture(scope="module")
def graphs(spark):
    chain = [f":n{i:02}" for i in range(30)]
    return build(
        spark,
        realistic=REALISTIC,
        cycle3=([":a", ":b", ":c"], [":a>:b", ":b>:c", ":c>:a"]),
        selfloop=([":app", ":lib"], [":app>:app", ":app>:lib"]),
        testcycle=([":a", ":b"], [":a>:b", ":b>:a@testImplementation"]),
        quirk=([":a", ":b", ":c"], [":a>:b", ":a>:c", ":b>:a", ":c>:b"]),
        parallel=([":a", ":b"], [":a>:b", ":a>:b@api", ":b>:a", ":b>:a@api"]),
        chain=(chain, [f"{a}>{b}" for a, b in zip(chain, chain[1:])]),
        solo=([":x"], []),
    ).cached()


def listed(df, by="graph_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[by], []).append(r)
    return out


def test_cycles(graphs):
    count = lambda **k: {g: len(r) for g, r in listed(kernels.cycles(graphs, **k)).items()}
    assert count() == {"cycle3": 1, "quirk": 1, "parallel": 2}
    assert count(include_test=True)["testcycle"] == 1 and count(dedupe=True)["parallel"] == 1
    assert kernels.back_edge_cycles([":a", ":b", ":c"], [(":a", ":b"), (":a", ":c"), (":b", ":a"), (":c", ":b")]) == [[":a", ":b"]]
    flags = {r.graph_id: r.has_cycle for r in reach.has_cycle(graphs).collect()}
    assert {g for g, x in flags.items() if x} == {"cycle3", "testcycle", "quirk", "parallel"}


def test_orders(graphs, spark):
    path = {g: [r.path for r in sorted(rows, key=lambda r: r.pos)] for g, rows in listed(kernels.critical_path(graphs)).items()}
    assert path["realistic"] == [":app", ":feature:home", ":core:data", ":core:domain"] and len(path["chain"]) == 30 and path["solo"] == [":x"]
    assert "cycle3" not in path and "selfloop" not in path
    assert kernels.topological_order(REALISTIC[0], [tuple(x.split(">")) for x in REALISTIC[1]]) == [":app", ":feature:login", ":feature:home", ":core:data", ":core:domain"]
    with pytest.raises(Exception, match="topological"):
        kernels.topo_order(build(spark, c=([":a", ":b"], [":a>:b", ":b>:a"]))).collect()


def test_metrics(graphs):
    rows = {r.path: r for r in metrics.module_metrics(graphs).where("graph_id = 'realistic'").collect()}
    got = {p: (r.fan_out, r.fan_in, round(r.instability, 4), r.transitive_count, r.health) for p, r in rows.items()}
    assert got == {":app": (2, 0, 1.0, 4, 68), ":feature:login": (1, 1, 0.5, 1, 84), ":feature:home": (2, 1, 0.6667, 2, 79), ":core:data": (1, 1, 0.5, 1, 84), ":core:domain": (0, 3, 0.0, 0, 100)}
    pairs = lambda n: {(r.module_a, r.module_b) for r in metrics.coupled_pairs(graphs, n).where("graph_id = 'realistic'").collect()}
    assert pairs(1) == {(":feature:login", ":feature:home"), (":core:domain", ":core:data")} and pairs(3) == set() and len(pairs(0)) == 10
    summary = {r.graph_id: r for r in metrics.graph_summary(graphs).collect()}
    assert summary["realistic"].critical_path_length == 4 and round(summary["realistic"].average_instability, 6) == 0.533333
    assert summary["testcycle"].has_cycles is False and summary["cycle3"].cycle_count == 1 and summary["solo"].isolated_module_count == 1


def test_random_graphs_against_joins(spark):
    rng = random.Random(9)
    made = {}
    for k in range(6):
        nodes = [f":m{i}" for i in range(rng.randint(2, 9))]
        made[f"g{k}"] = (nodes, [f"{rng.choice(nodes)}>{rng.choice([*nodes, ':ghost'])}@{rng.choice(['api', 'testApi', 'implementation'])}" for _ in range(rng.randint(1, 16))])
    g = build(spark, **made).cached()
    for include_test in (True, False):
        a, b = ({tuple(r) for r in reach.transitive_pairs(g, include_test, large).collect()} for large in (False, True))
        assert a == b
        on_scc = {(r.graph_id, r.path) for r in reach.scc_members(g, include_test).collect()}
        on_dfs = {(r.graph_id, r.path) for r in metrics.cycle_node_set(g, include_test).collect()}
        assert on_dfs <= on_scc
        assert {x for x, _ in on_dfs} == {r.graph_id for r in reach.has_cycle(g, include_test).collect() if r.has_cycle}
        by_joins = Graph(g.modules, g.edges, large=True)
        assert {tuple(r) for r in reach.has_cycle(by_joins, include_test).collect()} == {tuple(r) for r in reach.has_cycle(g, include_test).collect()}
        assert {(r.graph_id, r.path) for r in reach.scc_members(by_joins, include_test).collect()} == on_scc
        assert {tuple(r) for r in reach.blast_radius(by_joins, include_test).collect()} == {tuple(r) for r in reach.blast_radius(g, include_test).collect()}


def test_levels_of_a_cyclic_graph_stop(spark):
    with pytest.raises(ValueError, match="cycle"):
        reach.topo_levels(build(spark, g=([":a", ":b"], [":a>:b", ":b>:a"])))


@pytest.mark.parametrize(
    ("pattern", "path", "ok"),
    [(":core:domain", ":core:domain", True), (":feature:*:domain", ":feature:login:sub:domain", False), (":feature:*:domain", ":feature:domain", False), (":core:*", ":core:domain:model", False), (":feature:**", ":feature", True), (":**", ":anything:deep", True), (":feature:*:**", ":feature:login:ui:extra", True), (":a.b", ":axb", False), (":feature:nation_1*", ":feature:nation_1x", False)],
)
def test_globs(pattern, path, ok):
    assert S.glob_test(pattern, path) is ok


def test_rules(spark):
    g = build(spark, g=([":app", ":feature:login:ui", ":feature:home:ui", ":feature:login:data", ":core:domain"], [":app>:feature:login:ui", ":feature:login:ui>:core:domain", ":feature:login:data>:core:domain", ":feature:login:data>:feature:login:ui", ":core:domain>:app@testImplementation"]))
    layers = ["core|:core:**||false", "data|:feature:*:data|core|true", "ui|:feature:*:ui,:app|core,data|true", "bad|entry"]
    engine = rules.Engine.from_config(layers, ":feature:**", [], ["max-transitive-dependencies:threshold:3", "layer-dependency:severity:WARNING", "x:y", "no-feature-to-feature:suppress::feature:login:data"])
    result = engine.evaluate(g)
    got = [(r.rule_id, r.severity) for r in result.violations.orderBy("rule_seq", "seq").collect()]
    assert got.count(("layer-dependency", "WARNING")) == 1 and ("no-feature-to-feature", "ERROR") not in got and ("test-cyclic-dependency", "INFO") in got
    assert "build.gradle.kts" in next(r.message for r in result.violations.collect() if r.rule_id == "layer-dependency")
    result.check()
    said = result.text("out/index.html")
    assert result.rules_evaluated == 4 and said.endswith("in 4 rules; report: out/index.html") and "[layer-dependency] WARNING: 1 violations\n  warning: Layer data" in said and "[info] 1 more" in said
    assert rules.Engine([rules.MaxTransitive(99)]).evaluate(g).text() == "All rules passed (1 rules evaluated)"
    for odd in ("+-5", "²", "", "1.5", "99999999999"):
        assert rules.parse_overrides([f"max-transitive-dependencies:threshold:{odd}"]).most_transitive is None
    assert rules.parse_overrides(["max-transitive-dependencies:threshold:+7"]).most_transitive == 7
    ghost = build(spark, g=([":feature:a:data"], [":feature:a:data>:feature:b:ui"]))
    assert rules.LayerRule(rules.parse_layers(layers)).evaluate(ghost).count() == 0  # the target is no module of the graph
    strict = rules.Engine([rules.NoCycles(True, 0)]).evaluate(build(spark, g=([":a", ":b"], [":a>:b", ":b>:a"])))
    assert {r.source for r in strict.violations.collect()} == {":a → :b", "cycle-regression"}
    with pytest.raises(rules.ArchitectureCheckFailed):
        strict.check()

    class NoAndroidBelow:
        """A rule of a project's own: nothing below the core may use an Android library."""

        id, severity = "no-android-below", "ERROR"

        def evaluate(self, graph):
            android = graph.modules.where("type = 'ANDROID_LIBRARY'").select("graph_id", F.col("path").alias("dst"))
            bad = graph.main_edges.where("src LIKE ':core:%'").join(android, ["graph_id", "dst"])
            return rules._violations(bad, F.col("edge_seq"), self.id, self.severity, F.concat("src", F.lit(" uses "), "dst"), F.col("src"), F.col("src"), "why")

    typed = build(spark, g=([":core:domain", ":lib:view", ":app"], [":core:domain>:lib:view", ":app>:lib:view"]))
    typed = Graph(typed.modules.withColumn("type", F.when(F.col("path") == ":lib:view", "ANDROID_LIBRARY").otherwise("UNKNOWN")), typed.edges)
    own = rules.Engine([NoAndroidBelow()], rules.parse_overrides(["no-android-below:severity:WARNING"])).evaluate(typed)
    assert [(r.rule_id, r.severity, r.message) for r in own.violations.collect()] == [("no-android-below", "WARNING", ":core:domain uses :lib:view")]
    was = spark.createDataFrame([("x", 1), ("y", 0)], "graph_id string, cycle_count int")
    two = build(spark, x=([":a", ":b"], [":a>:b", ":b>:a"]), y=([":a", ":b"], [":a>:b", ":b>:a"]), z=([":a", ":b"], [":a>:b", ":b>:a"]))
    assert [r.graph_id for r in rules.NoCycles(True, was).evaluate(two).where("source = 'cycle-regression'").collect()] == ["y"]

    class Broken:
        id, severity = "broken", "ERROR"

        def evaluate(self, graph):
            return graph.modules.select(F.raise_error(F.lit("no")).alias("x"))

    assert [r.source for r in rules.Engine([Broken()]).evaluate(g).violations.collect()] == ["RuleEngine"]
    assert rules.parse_teams(rules.format_teams([("a", ["x", "y"]), ("b", ["z"])])) == (("a", ("x", "y")), ("b", ("z",)))


def test_json_round_trip_and_reports(spark, tmp_path):
    g = build(spark, g=([":app", ":lib"], [":app>:lib", ":lib>:app"]))
    text = sources.to_json(g).first().json
    again = sources.from_json(spark.createDataFrame([("g", text)], "graph_id string, json string"))
    assert again.edges.collect() == g.edges.collect() and again.modules.collect() == g.modules.collect()
    assert json.loads(text)["modules"][0]["healthScore"] is None
    old = json.dumps({"projectName": "p", "modules": [{"path": ":a", "name": "a", "type": "KMP"}], "edges": [], "extra": 1})
    odd = spark.createDataFrame([("g", old)], "graph_id string, json string")
    assert sources.from_json(odd).modules.first().plugins == []
    for bad, strict in ((odd, True), (odd.withColumn("json", F.lit('{"projectName":"p"}')), False)):
        with pytest.raises(Exception, match="not a graph"):
            sources.from_json(bad, strict).modules.collect()
    result = rules.Engine.built_in().evaluate(g)
    envelope = json.loads(reports.json_envelope(g, result, "T").first().json)
    assert envelope["summary"]["cycleCount"] == 1 and envelope["violations"][0]["ruleId"] == "no-cyclic-dependencies"
    assert sources.previous_cycle_count(spark.createDataFrame([("g", json.dumps(envelope)), ("h", "{}")], "graph_id string, json string")).collect()[0].cycle_count == 1
    sarif = json.loads(reports.sarif(g, result).first().json)
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "app/build.gradle.kts"
    xml = ET.fromstring(reports.junit(g, result, "T", "a<b").first().xml.encode())
    assert xml.attrib["failures"] == "1" and xml[0].attrib["name"] == "a<b"
    page = json.loads(reports.html_summary(g, result).first().json)
    assert len(page) == 24 and page["mainCycleEdges"] == [":app→:lib", ":lib→:app"]
    shown = reports.html('{"a":"</script>"}', "{}", "t<", timestamp="T1", version="9")
    assert 'id="graph-data">\n{"a":"<\\/script>"}' in shown and "t&lt;" in shown and "Generated at T1, version 9" in shown and reports.DATA_MARK not in shown
    assert pytest.raises(ValueError, reports.html, "{}", "{}", "t", "none")
    reports.ReportWriter(g, result, str(tmp_path), "T", ts=7).write()
    document = lambda name: spark.read.text(f"{tmp_path}/{name}", wholetext=True).first().value
    assert [x["ts"] for x in json.loads(document("trend-next"))] == [7] and "summary-data" in document("index.html")
    assert json.loads(document("result.json")) == envelope and json.loads(document("graph.json")) == json.loads(text)
    reports.ReportWriter(g, result, f"{tmp_path}/second", "T", trend=f"{tmp_path}/trend-next", ts=8).write()
    assert [(x["ts"], x["cycles"]) for x in json.loads(document("second/trend-next"))] == [(7, 1), (8, 1)] and '"ts":7' in document("second/index.html")
    sources.write_json(g, f"{tmp_path}/graphs")
    assert sources.read_json(spark, f"{tmp_path}/graphs/*").edges.drop("graph_id").collect() == g.edges.drop("graph_id").collect()
    assert spark.read.csv(f"{tmp_path}/metrics.csv", header=True).columns == "timestamp,module,type,fanIn,fanOut,instability,transitiveDepCount,healthScore,isGodModule,isOnCriticalPath,hasCycle".split(",")
    assert json.loads(reports.append_trend("broken", {"ts": 1})) == [{"ts": 1}] and len(json.loads(reports.append_trend(json.dumps([{"ts": i} for i in range(40)] + [3]), {"ts": 99}))) == 30


def test_insights_and_trend_stream(spark, tmp_path, graphs):
    g = build(spark, g=REALISTIC)
    trail = [r.path for r in reach.shortest_path(g, ":app", ":core:domain").orderBy("pos").collect()]
    assert trail == [":app", ":feature:home", ":core:domain"]
    assert {r.kind for r in insight.edge_kinds(graphs, metrics.cycle_edges(graphs)).where("graph_id = 'cycle3'").collect()} == {"main_cycle"}
    from gridloom.streaming.trend import keep_trend

    rows = spark.range(50).select(F.lit("g").alias("graph_id"), F.col("id").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    keep_trend(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/trend", f"{tmp_path}/ck").awaitTermination()
    assert {r.ts for r in spark.read.parquet(f"{tmp_path}/trend/v0").collect()} == set(range(20, 50))
