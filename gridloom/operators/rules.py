"""Architecture rules, their configuration, and the engine that evaluates them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import kernels, reach
from gridloom.sources.graph import Graph

VIOLATIONS = "graph_id string, seq long, rule_id string, severity string, message string, source string, module_hint string, plain_language_explanation string"
ARROW = " → "


class ArchitectureCheckFailed(Exception):
    """An error-level violation was found."""


class Rule(Protocol):
    """Anything with an id, a severity and an evaluation to rows of ``VIOLATIONS``."""

    id: str
    severity: str

    def evaluate(self, g: Graph) -> DataFrame: ...


def _violations(df: DataFrame, seq: Column, rule_id: str, severity: str, message: Column, source: Column, hint: Column, why: str) -> DataFrame:
    return df.select("graph_id", seq.cast("long").alias("seq"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"), source.alias("source"), hint.alias("module_hint"), F.lit(why).alias("plain_language_explanation"))


def _located(path: Column, g: Graph, df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with the build file of a module, and the words that name it."""
    files = g.lookup().select("graph_id", F.col("path").alias("hint_path"), "build_file_path")
    out = df.withColumn("hint_path", path).join(files, ["graph_id", "hint_path"], "left")
    return out, F.coalesce(F.concat(F.lit(" [declared in "), F.col("build_file_path"), F.lit("]")), F.lit(""))


@dataclass(frozen=True)
class NoCycles:
    """An error for each main cycle; one more if there are more than before and ``prevent_regression``; an info for each cycle that tests alone close.

    ``previous``: the number of cycles before, for all graphs or as ``(graph_id, cycle_count)``; graphs without one can't regress.
    """

    prevent_regression: bool = False
    previous: int | DataFrame | None = None
    id: str = "no-cyclic-dependencies"
    severity: str = "ERROR"

    def evaluate(self, g: Graph) -> DataFrame:
        main = kernels.cycles(g, dedupe=True).withColumn("nodes", F.array_sort("cycle"))
        path = F.array_join("cycle", ARROW)
        out = _violations(main, F.col("cycle_seq"), self.id, self.severity, F.concat(F.lit("Modules depend on each other in a circle: "), path), path, F.col("cycle")[0], "Modules in a circle cannot be built, tested or changed one without the others.")
        if self.prevent_regression and self.previous is not None:
            now = main.groupBy("graph_id").agg(F.count("*").alias("n"))
            now = now.join(self.previous.select("graph_id", F.col("cycle_count").alias("was")), "graph_id") if isinstance(self.previous, DataFrame) else now.withColumn("was", F.lit(self.previous))
            now = now.where("n > was")
            text = F.format_string("%d more cycles than before: there were %d, now there are %d", F.col("n") - F.col("was"), F.col("was"), F.col("n"))
            out = out.unionByName(_violations(now, F.lit(1 << 30), self.id, self.severity, text, F.lit("cycle-regression"), F.lit(None).cast("string"), "The number of cycles may not grow."))
        every = kernels.cycles(g, include_test=True, dedupe=True).withColumn("nodes", F.array_sort("cycle"))
        only = every.join(main.select("graph_id", "nodes"), ["graph_id", "nodes"], "left_anti")
        info = _violations(only, F.col("cycle_seq") + (1 << 31), "test-cyclic-dependency", "INFO", F.concat(F.lit("A circle that only test dependencies close: "), path), path, F.col("cycle")[0], "Circles through tests do not break the build but show test code in an odd place.")
        return out.unionByName(info)


@dataclass(frozen=True)
class Layer:
    name: str
    patterns: tuple[str, ...]
    allowed: tuple[str, ...] = ()
    restricted: bool = False


@dataclass(frozen=True)
class LayerRule:
    """Main edges between layers must be allowed by the layer they leave; the first layer that matches holds."""

    layers: tuple[Layer, ...]
    id: str = "layer-dependency"
    severity: str = "ERROR"

    def edges(self, g: Graph) -> DataFrame:
        """Main edges with both ends known modules in a layer, and whether each is allowed."""
        named = [(x.name, x.patterns) for x in self.layers]
        layered = g.modules.select("graph_id", "path", S.first_match(F.col("path"), named).alias("layer")).where("layer IS NOT NULL").distinct()
        out = g.main_edges
        for end, name in (("src", "from_layer"), ("dst", "to_layer")):
            out = out.join(layered.select("graph_id", F.col("path").alias(end), F.col("layer").alias(name)), ["graph_id", end])
        ok, words = F.lit(True), F.lit("")
        for x in reversed(self.layers):
            here = F.col("from_layer") == x.name
            ok = F.when(here, F.lit(not x.restricted) | F.col("to_layer").isin(x.name, *x.allowed)).otherwise(ok)
            words = F.when(here, ", ".join(x.allowed) or "(nothing)").otherwise(words)
        return out.withColumns({"allowed": ok, "may_use": words})

    def evaluate(self, g: Graph) -> DataFrame:
        bad, where = _located(F.col("src"), g, self.edges(g).where("NOT allowed"))
        if not any(x.restricted for x in self.layers):
            bad = bad.where("false")
        text = F.concat(F.lit("Layer "), F.col("from_layer"), F.lit(" must not use layer "), F.col("to_layer"), F.lit(": "), "src", F.lit(ARROW), "dst", F.lit(". It may use: "), "may_use", where)
        return _violations(bad, F.col("edge_seq"), self.id, self.severity, text, F.concat("src", F.lit(ARROW), "dst"), F.col("src"), "Layers keep details from leaking upwards; this dependency goes round them.")


@dataclass(frozen=True)
class FeatureIsolation:
    """Modules that match the pattern must not depend on one another, but for allowed pairs of globs."""

    pattern: str
    allowed: tuple[tuple[str, str], ...] = ()
    id: str = "no-feature-to-feature"
    severity: str = "ERROR"

    def evaluate(self, g: Graph) -> DataFrame:
        features = g.modules.where(S.glob_match(F.col("path"), self.pattern)).select("graph_id", F.col("path").alias("p")).distinct()
        active = features.groupBy("graph_id").count().where("count >= 2").select("graph_id")
        edges = g.main_edges.join(active, "graph_id", "left_semi")
        for end in ("src", "dst"):
            edges = edges.join(features.withColumnRenamed("p", end), ["graph_id", end], "left_semi")
        for a, b in self.allowed:
            edges = edges.where(~(S.glob_match(F.col("src"), a) & S.glob_match(F.col("dst"), b)))
        bad, where = _located(F.col("src"), g, edges)
        text = F.concat(F.lit("Feature "), "src", F.lit(" uses feature "), "dst", where)
        return _violations(bad, F.col("edge_seq"), self.id, self.severity, text, F.concat("src", F.lit(ARROW), "dst"), F.col("src"), "Features that know each other can no longer be built, tested or dropped alone.")


@dataclass(frozen=True)
class MaxTransitive:
    """Modules that reach more than ``most`` others, over all edges."""

    most: int
    id: str = "max-transitive-dependencies"
    severity: str = "WARNING"

    def evaluate(self, g: Graph) -> DataFrame:
        bad, where = _located(F.col("path"), g, reach.transitive_count(g).where(F.col("transitive_count") > self.most))
        text = F.concat(F.col("path"), F.format_string(f" reaches %d modules, more than {self.most}", "transitive_count"), where)
        return _violations(bad, F.col("module_seq"), self.id, self.severity, text, F.col("path"), F.col("path"), "A module that reaches much of the project is rebuilt whenever any of it changes.")


# -------------------------------------------------------------- configuration
@dataclass(frozen=True)
class Config:
    severities: dict[str, str] = field(default_factory=dict)
    suppressed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    prevent_regression: bool = False
    most_transitive: int | None = None


def parse_layers(entries: Sequence[str]) -> tuple[Layer, ...]:
    """``name|pattern,pattern|allowed,allowed|true``; entries of fewer parts are skipped."""
    out = []
    listed = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    for e in entries:
        parts = e.split("|")
        if len(parts) >= 4:
            out.append(Layer(parts[0], listed(parts[1]), listed(parts[2]), parts[3].lower() == "true"))
    return tuple(out)


def parse_allowed(entries: Sequence[str]) -> tuple[tuple[str, str], ...]:
    """``from->to``; without an arrow the target is the empty glob."""
    return tuple((a, b) for a, _, b in (e.partition("->") for e in entries))


def parse_overrides(entries: Sequence[str]) -> Config:
    """``id:severity:LEVEL``, ``id:suppress:glob``, ``id:option:preventRegression``, ``id:threshold:N``; what can't be read is skipped."""
    severities: dict[str, str] = {}
    suppressed: dict[str, tuple[str, ...]] = {}
    regression, most = False, None
    for e in entries:
        parts = e.split(":", 2)
        if len(parts) < 3:
            continue
        rule, kind, value = parts
        if kind == "severity" and value in S.SEVERITIES:
            severities[rule] = value
        elif kind == "suppress":
            suppressed[rule] = (*suppressed.get(rule, ()), value)
        elif kind == "option" and rule == NoCycles.id and value == "preventRegression":
            regression = True
        elif kind == "threshold" and rule == MaxTransitive.id:
            number = int(value) if re.fullmatch(r"[+-]?\d+", value) else None
            most = number if number is not None and -(2**31) <= number < 2**31 else None
    return Config(severities, suppressed, regression, most)


def parse_teams(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """``team=glob,glob;team=glob``, in order of precedence."""
    return tuple((name.strip(), tuple(p.strip() for p in globs.split(",") if p.strip())) for name, sep, globs in (t.partition("=") for t in text.split(";")) if sep)


def format_teams(teams: Sequence[tuple[str, Sequence[str]]]) -> str:
    return ";".join(f"{name}={','.join(globs)}" for name, globs in teams)


# --------------------------------------------------------------------- engine
@dataclass(frozen=True)
class Result:
    violations: DataFrame
    rules_evaluated: int

    def counts(self) -> DataFrame:
        """``(graph_id, error_count, warning_count, info_count, has_build_failure)`` of graphs with violations."""
        of = lambda s: F.count_if(F.col("severity") == s).cast("int")
        return self.violations.groupBy("graph_id").agg(of("ERROR").alias("error_count"), of("WARNING").alias("warning_count"), of("INFO").alias("info_count"), (of("ERROR") > 0).alias("has_build_failure"))

    def by_rule(self) -> DataFrame:
        """Rules in order of their first violation, with its severity."""
        at = F.struct("rule_seq", "seq")
        return self.violations.groupBy("graph_id", "rule_id").agg(F.count("*").cast("int").alias("n"), F.min_by("severity", at).alias("severity"), F.min(at).alias("at")).orderBy("graph_id", "at").drop("at")

    def text(self, report: str | None = None, most: int = 1000) -> str:
        """The run for people: each rule's errors and warnings by rule, how many infos there are, and the totals by level.

        Of a rule with more than ``most`` messages the first ones and the number of the others are shown.
        """
        shown = self.violations.where("severity != 'INFO'")
        nth = Window.partitionBy("rule_id").orderBy("rule_seq", "graph_id", "seq")
        by_rule: dict[str, list] = {}
        for r in shown.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most).orderBy("rule_seq", "nth").collect():
            by_rule.setdefault(r.rule_id, []).append(r)
        totals = {(r.rule_id, r.severity): r["count"] for r in self.violations.groupBy("rule_id", "severity").count().collect()}
        of = lambda level: sum(n for (_, s), n in totals.items() if s == level)
        if not totals:
            return f"All rules passed ({self.rules_evaluated} rules evaluated)"
        lines = []
        for rule, rows in by_rule.items():
            n = sum(x for (i, s), x in totals.items() if i == rule and s != "INFO")
            lines.append(f"[{rule}] {rows[0].severity}: {n} violations")
            lines += [f"  {r.severity.lower()}: {r.message}" for r in rows]
            lines += [f"  and {n - len(rows)} more"] if n > len(rows) else []
        if of("INFO"):
            lines.append(f"[info] {of('INFO')} more for information")
        level = ", ".join(f"{of(s)} {word}" for s, word in (("ERROR", "errors"), ("WARNING", "warnings")) if of(s))
        return "\n".join([*lines, f"{level or 'no errors or warnings'} in {self.rules_evaluated} rules" + (f"; report: {report}" if report else "")])

    def check(self) -> None:
        """Raises if any violation is an error."""
        n = self.violations.where("severity = 'ERROR'").count()
        if n:
            raise ArchitectureCheckFailed(f"{n} violations of error level")


class Engine:
    def __init__(self, rules: Sequence[Rule], config: Config | None = None) -> None:
        self.rules, self.config = tuple(rules), config or Config()

    @staticmethod
    def built_in() -> Engine:
        return Engine([NoCycles()])

    @staticmethod
    def from_config(layers: Sequence[str] = (), feature_pattern: str = "", allowed: Sequence[str] = (), overrides: Sequence[str] = (), previous_cycles: int | None = None) -> Engine:
        config = parse_overrides(overrides)
        rules: list[Rule] = [NoCycles(config.prevent_regression, previous_cycles)]
        if layers:
            rules.append(LayerRule(parse_layers(layers)))
        if feature_pattern.strip():
            rules.append(FeatureIsolation(feature_pattern, parse_allowed(allowed)))
        if config.most_transitive is not None:
            rules.append(MaxTransitive(config.most_transitive))
        return Engine(rules, config)

    def adjusted(self, rule_id: str, found: DataFrame) -> DataFrame:
        """Suppression, then severity, both by the rule that owns the violations; infos keep theirs."""
        globs = self.config.suppressed.get(rule_id, ())
        subject = F.coalesce("module_hint", F.split_part("source", F.lit(" "), F.lit(1)))
        if globs:
            found = found.where(~S.glob_any(subject, globs))
        level = self.config.severities.get(rule_id)
        return found.withColumn("severity", F.when(F.col("severity") != "INFO", level).otherwise(F.col("severity"))) if level else found

    def evaluate(self, g: Graph, isolate: bool = True) -> Result:
        """All rules in order. ``isolate``: each rule is computed by itself, and one that fails becomes an error of its own; else all stay lazy."""
        out = g.spark.createDataFrame([], VIOLATIONS).withColumn("rule_seq", F.lit(0))
        for i, rule in enumerate(self.rules):
            try:
                found = self.adjusted(rule.id, rule.evaluate(g))
                if isolate:
                    found = found.persist()
                    found.count()
            except Exception as e:  # noqa: BLE001
                text = f"Rule {rule.id} failed: {str(e).splitlines()[0][:300]}"
                found = g.modules.select("graph_id").distinct().select("graph_id", F.lit(0).cast("long").alias("seq"), F.lit(rule.id).alias("rule_id"), F.lit("ERROR").alias("severity"), F.lit(text).alias("message"), F.lit("RuleEngine").alias("source"), F.lit(None).cast("string").alias("module_hint"), F.lit(None).cast("string").alias("plain_language_explanation"))
            out = out.unionByName(found.withColumn("rule_seq", F.lit(i)))
        return Result(out, len(self.rules))
