"""The queries without SQL, over the tables' graph, against plain recursive Python."""

import json
import os
import sys
import xml.etree.ElementTree as ET

import pytest

from gridloom.plans import catalog

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
sys.setrecursionlimit(10_000)


def plain(spark, kind):
    g = catalog.graph(spark, SF, kind)
    nodes = [r.path for r in g.modules.orderBy("module_seq").collect()]
    return nodes, [(r.src, r.dst, r.configuration) for r in g.edges.orderBy("edge_seq").collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return plain(spark, "mixed")


@pytest.fixture(scope="module")
def dag(spark):
    return plain(spark, "dag")


def main(edges):
    return [(a, b) for a, b, c in edges if "test" not in c.lower()]


def walk_cycles(nodes, edges):
    """Cycles that a recursive depth-first walk closes."""
    found, state, trail = [], {}, []

    def visit(n):
        state[n] = 1
        trail.append(n)
        for a, b in edges:
            if a == n and b != n:
                if state.get(b) == 1:
                    found.append(trail[trail.index(b) :])
                elif b not in state:
                    visit(b)
        trail.pop()
        state[n] = 2

    for n in nodes:
        if n not in state:
            visit(n)
    return found


def first_of_each_set(cycles):
    return [c for i, c in enumerate(cycles) if all(set(c) != set(d) for d in cycles[:i])]


def fans(nodes, edges):
    e = main(edges)
    return {n: (sum(b == n for _, b in e), sum(a == n for a, _ in e)) for n in nodes}


def reached(edges, n):
    out, todo = set(), [n]
    while todo:
        at = todo.pop()
        for a, b, _ in edges:
            if a == at and b not in out:
                out.add(b)
                todo.append(b)
    return out


def kahn(nodes, edges):
    """Again and again the free node that became free first; of those free at the start the first."""
    e, waits = main(edges), {}
    for n in nodes:
        waits[n] = sum(b == n for _, b in e)
    queue, out = [n for n in nodes if not waits[n]], []
    while queue:
        at, queue = queue[0], queue[1:]
        out.append(at)
        for a, b in e:
            if a == at and b in waits:
                waits[b] -= 1
                if not waits[b]:
                    queue.append(b)
    return out


def collected(spark, name, *order):
    rows = catalog.QUERIES[name](spark, SF)
    return [tuple(r) for r in (rows.orderBy(*order) if order else rows).collect()]


def test_cycles(spark, mixed):
    nodes, edges = mixed
    every, on_main = walk_cycles(nodes, [(a, b) for a, b, _ in edges]), walk_cycles(nodes, main(edges))
    for name, want in (("cycles_all", every), ("cycles_main", on_main), ("cycles_dedup", first_of_each_set(on_main))):
        assert [c for _, c in collected(spark, name, "cycle_seq")] == [" > ".join(c) for c in want]
    assert on_main and len(every) >= len(on_main)
    got = collected(spark, "cycle_edges", "cycle_seq", "pos")
    assert [(a, b) for _, _, a, b in got] == [(c[i], c[(i + 1) % len(c)]) for c in on_main for i in range(len(c))]
    found = [r.source for r in catalog.QUERIES["cycle_violations"](spark, SF).orderBy("seq").collect()]
    assert found == [" → ".join(c) for c in first_of_each_set(on_main)]
    tests = [c for c in first_of_each_set(every) if all(set(c) != set(d) for d in on_main)]
    infos = catalog.QUERIES["test_cycle_violations"](spark, SF).orderBy("seq").collect()
    assert [(r.source, r.severity) for r in infos] == [(" → ".join(c), "INFO") for c in tests]
    regression = catalog.QUERIES["cycle_regression"](spark, SF).collect()
    assert len(regression) == 1 and str(len(found)) in regression[0].message


def test_order_and_critical_path(spark, dag):
    nodes, edges = dag
    order = kahn(nodes, edges)
    assert [p for _, p in collected(spark, "topo_order", "topo_pos")] == order and len(order) == len(nodes)
    assert [r.path for r in catalog.insight.matrix_order(catalog.dag(spark, SF), "topology").orderBy("pos").collect()] == order
    e, depth = main(edges), {}

    def deepest(n):
        if n not in depth:
            depth[n] = 1 + max((deepest(a) for a, b in e if b == n), default=-1)
        return depth[n]

    length = max(map(deepest, nodes))
    path = [p for _, p in collected(spark, "critical_path", "pos")]
    assert len(path) == length + 1 and all(p in e for p in zip(path, path[1:]))
    assert path[-1] == next(n for n in order if depth[n] == length)  # the first deepest in topological order
    for a, b in zip(path, path[1:]):  # by the first best predecessor in that order
        assert a == next(n for n in order if (n, b) in e and depth[n] == depth[b] - 1)


def health(nodes, edges):
    on = {n for c in walk_cycles(nodes, main(edges)) for n in c}
    out = {}
    for n, (i, o) in fans(nodes, edges).items():
        loss = 30 * (o / (i + o) if i + o else 0) + 25 * (i >= 5 and o >= 5) + 25 * (n in on) + 20 * min(len(reached(edges, n)) / 50, 1)
        out[n] = int(max(0, min(100, 100 - loss)))
    return out


def test_health_and_summary(spark, mixed):
    nodes, edges = mixed
    assert dict(collected(spark, "health_score_dfs")) == health(nodes, edges)
    f, cycles = fans(nodes, edges), walk_cycles(nodes, main(edges))
    row = catalog.QUERIES["graph_summary_mixed"](spark, SF).first()
    instability = sum(o / (i + o) if i + o else 0 for i, o in f.values()) / len(nodes)
    assert (row.total_modules, row.total_edges, row.cycle_count, row.has_cycles) == (len(nodes), len(edges), len(cycles), bool(cycles))
    assert (row.max_fan_in, row.max_fan_out) == (max(i for i, _ in f.values()), max(o for _, o in f.values())) and abs(row.average_instability - instability) < 1e-6
    assert row.critical_path_length == 0 and row.god_module_count == sum(i >= 5 and o >= 5 for i, o in f.values()) and row.isolated_module_count == sum(i + o == 0 for i, o in f.values())


def test_edge_kinds(spark, mixed):
    nodes, edges = mixed
    pairs = lambda cycles: {(c[i], c[(i + 1) % len(c)]) for c in cycles for i in range(len(c))}
    on, every = pairs(walk_cycles(nodes, main(edges))), pairs(walk_cycles(nodes, [(a, b) for a, b, _ in edges]))

    def kind(a, b, c):
        if "test" in c.lower():
            return "test_cycle" if (a, b) in every else "test"
        if (a, b) in on:
            return "main_cycle"
        return "compile_only" if "compileonly" in c.lower() else "api" if c == "api" else "source_set" if c.startswith("commonMain") else "implementation"

    assert {(r.src, r.dst, r.configuration): r.kind for r in catalog.QUERIES["edge_kinds"](spark, SF).collect()} == {e: kind(*e) for e in edges}


def test_documents(spark, mixed):
    nodes, edges = mixed
    violations = catalog._all_rules(catalog.mixed(spark, SF)).violations.orderBy("rule_seq", "seq").collect()
    envelope = json.loads(catalog.QUERIES["json_envelope"](spark, SF).first().json)
    assert [m["path"] for m in envelope["graph"]["modules"]] == nodes and [(e["from"], e["to"], e["configuration"]) for e in envelope["graph"]["edges"]] == edges
    assert [(v["ruleId"], v["severity"], v["source"]) for v in envelope["violations"]] == [(v.rule_id, v.severity, v.source) for v in violations]
    assert envelope["summary"]["cycleCount"] == len(walk_cycles(nodes, main(edges)))
    sarif = json.loads(catalog.QUERIES["sarif_report"](spark, SF).first().json)["runs"][0]
    level = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}
    assert [(r["ruleId"], r["level"], r["message"]["text"]) for r in sarif["results"]] == [(v.rule_id, level[v.severity], v.message) for v in violations]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == list(dict.fromkeys(v.rule_id for v in violations))
    suite = ET.fromstring(catalog.QUERIES["junit_report"](spark, SF).first().xml.encode())
    cases = suite.findall(".//testcase")
    assert [(c.get("name"), c.get("classname"), c.find("failure") is not None) for c in cases] == [(v.rule_id, v.source, v.severity == "ERROR") for v in violations]
    page = json.loads(catalog.QUERIES["html_summary"](spark, SF).first().json)
    assert page["errorCount"] == sum(v.severity == "ERROR" for v in violations) and page["warningCount"] == sum(v.severity == "WARNING" for v in violations)
    cycles = walk_cycles(nodes, main(edges))
    assert page["mainCycleNodes"] == list(dict.fromkeys(n for c in cycles for n in c)) and page["mainCycleEdges"] == [f"{c[i]}→{c[(i + 1) % len(c)]}" for c in cycles for i in range(len(c))]
    assert page["isolatedModulePaths"] == [n for n, (i, o) in fans(nodes, edges).items() if i + o == 0]
