"""Operators whose result depends on the order of visits: one call for each graph, spread by ``graph_id``.

Graphs are small (hundreds of modules); collections of them are not, and scale by the number of graphs. For one large
graph use the joins in ``reach``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.graph import Graph

Pairs = Sequence[tuple[str, str]]


def _targets(edges: Pairs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


def back_edge_cycles(nodes: Sequence[str], edges: Pairs, dedupe: bool = False) -> list[list[str]]:
    """Cycles that a depth-first walk in the order of nodes and edges closes; self-loops are none.

    A node left behind is not entered again, so this is neither all cycles nor one for each
    strongly connected component. ``dedupe``: of cycles with the same nodes the first.
    """
    after, done, found, sets = _targets(edges), set(), [], set()
    for start in nodes:
        if start in done:
            continue
        done.add(start)
        place, trail = {start: 0}, [(start, iter(after.get(start, ())))]
        while trail:
            node, rest = trail[-1]
            step = next(rest, None)
            if step is None:
                trail.pop()
                del place[node]
            elif step in place:
                cycle = [n for n, _ in trail[place[step] :]]
                if len(cycle) > 1 and not (dedupe and frozenset(cycle) in sets):
                    sets.add(frozenset(cycle))
                    found.append(cycle)
            elif step not in done:
                done.add(step)
                place[step] = len(trail)
                trail.append((step, iter(after.get(step, ()))))
    return found


def topological_order(nodes: Sequence[str], edges: Pairs) -> list[str] | None:
    """Dependents first, first in first out; None if a cycle, a self-loop or an edge from an unknown node holds some back."""
    known, waits = set(nodes), dict.fromkeys(nodes, 0)
    after = _targets(edges)
    for _, b in edges:
        if b in known:
            waits[b] += 1
    ready, order = deque(n for n in nodes if not waits[n]), []
    while ready:
        node = ready.popleft()
        order.append(node)
        for b in after.get(node, ()):
            if b in known:
                waits[b] -= 1
                if not waits[b]:
                    ready.append(b)
    return order if len(order) == len(nodes) else None


def longest_chain(nodes: Sequence[str], edges: Pairs) -> list[str]:
    """The longest chain of nodes; of equally long ones that to the first deepest node, by the first best predecessor. Empty if cyclic."""
    order = topological_order(nodes, edges)
    if not order:
        return []
    after, depth, via = _targets(edges), dict.fromkeys(order, 0), {}
    for node in order:
        for b in after.get(node, ()):
            if depth[node] + 1 > depth.get(b, 0):
                depth[b], via[b] = depth[node] + 1, node
    chain = [max(depth, key=depth.__getitem__)]
    while chain[-1] in via:
        chain.append(via[chain[-1]])
    return chain[::-1]


def reachable(nodes: Sequence[str], edges: Pairs) -> Iterable[tuple[str, str]]:
    """(node, reached) pairs; a node reaches itself only by a cycle or a self-loop."""
    after = _targets(dict.fromkeys(edges))
    for start in dict.fromkeys(nodes):
        seen, queue = set(), deque([start])
        while queue:
            for b in after.get(queue.popleft(), ()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        yield from ((start, b) for b in seen)


def closes_cycle(nodes: Sequence[str], edges: Pairs) -> bool:
    """Whether a walk from the nodes meets a cycle of two or more; one walk over nodes and edges."""
    return bool(back_edge_cycles(nodes, edges))


def strong_members(nodes: Sequence[str], edges: Pairs) -> list[str]:
    """Nodes in a strongly connected component of two or more, in one walk: a component is closed when its first node is left."""
    after, index, low, open_, waiting = _targets(edges), {}, {}, set(), []
    known, out = set(nodes), []
    for start in nodes:
        if start in index:
            continue
        trail = [(start, iter(after.get(start, ())))]
        index[start] = low[start] = len(index)
        waiting.append(start)
        open_.add(start)
        while trail:
            node, rest = trail[-1]
            step = next(rest, None)
            if step is None:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == index[node]:
                    part = [waiting.pop()]
                    while part[-1] != node:
                        part.append(waiting.pop())
                    open_.difference_update(part)
                    if len(part) > 1:
                        out += [n for n in part if n in known]
            elif step not in index:
                index[step] = low[step] = len(index)
                waiting.append(step)
                open_.add(step)
                trail.append((step, iter(after.get(step, ()))))
            elif step in open_:
                low[node] = min(low[node], index[step])
    return out


def per_graph(g: Graph, kernel: Callable[[list[str], list[tuple[str, str]]], Iterable[tuple]], columns: str, include_test: bool) -> DataFrame:
    """``kernel(nodes, edges)`` of each graph, both in order, as rows of ``columns`` behind ``graph_id``."""
    nodes = g.modules.select("graph_id", F.col("module_seq").cast("long").alias("seq"), F.col("path").alias("a"), F.lit(None).cast("string").alias("b"))
    rows = nodes.unionByName(g.edge_set(include_test).select("graph_id", F.col("edge_seq").alias("seq"), F.col("src").alias("a"), F.col("dst").alias("b")))
    names = ["graph_id", *(c.split()[0] for c in columns.split(", "))]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        node = pdf["b"].isna()
        out = kernel(pdf.loc[node, "a"].tolist(), list(zip(pdf.loc[~node, "a"], pdf.loc[~node, "b"], strict=True)))
        return pd.DataFrame([(key[0], *r) for r in out], columns=names)

    return rows.groupBy("graph_id").applyInPandas(run, f"graph_id string, {columns}")


def cycles(g: Graph, include_test: bool = False, dedupe: bool = False) -> DataFrame:
    return per_graph(g, lambda n, e: enumerate(back_edge_cycles(n, e, dedupe)), "cycle_seq int, cycle array<string>", include_test)


def topo_order(g: Graph) -> DataFrame:
    """Fails for a graph that has none."""

    def kernel(nodes: list[str], edges: list[tuple[str, str]]) -> Iterable[tuple]:
        order = topological_order(nodes, edges)
        if order is None:
            raise ValueError("no topological order: the graph has a cycle; list its cycles to see them")
        return enumerate(order)

    return per_graph(g, kernel, "topo_pos int, path string", False)


def critical_path(g: Graph) -> DataFrame:
    return per_graph(g, lambda n, e: enumerate(longest_chain(n, e)), "pos int, path string", False)


def reach_pairs(g: Graph, include_test: bool = True) -> DataFrame:
    return per_graph(g, reachable, "src string, dst string", include_test)
