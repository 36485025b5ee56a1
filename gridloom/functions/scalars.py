"""Column expressions over module paths, configurations and plugin names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the build tool gives to configurations.
PRODUCTION_CONFIGS = ("implementation", "api", "compileOnly", "runtimeOnly")
TEST_CONFIGS = (
    "testImplementation", "testRuntimeOnly", "testApi", "testCompileOnly",
    "androidTestImplementation", "androidTestRuntimeOnly", "debugImplementation", "releaseImplementation",
)
STANDARD_CONFIGS = PRODUCTION_CONFIGS + TEST_CONFIGS[:4]
SUFFIXES = ("Implementation", "Api", "CompileOnly", "RuntimeOnly")

# Module types, by substrings of plugin class names and by plugin ids, in order of precedence.
TYPE_BY_CLASS = (
    ("KMP", ("KotlinMultiplatformPluginWrapper", "kotlin.multiplatform")),
    ("KMP_ANDROID_LIBRARY", ("com.android.kotlin.multiplatform",)),
    ("ANDROID_APP", ("AppPlugin", "com.android.application")),
    ("ANDROID_LIBRARY", ("LibraryPlugin", "com.android.library", "DynamicFeaturePlugin")),
    ("JVM_LIBRARY", ("KotlinPluginWrapper", "JavaLibraryPlugin", "JavaPlugin")),
)
TYPE_BY_ID = (
    ("KMP", ("org.jetbrains.kotlin.multiplatform",)),
    ("KMP_ANDROID_LIBRARY", ("com.android.kotlin.multiplatform.library",)),
    ("ANDROID_APP", ("com.android.application",)),
    ("ANDROID_LIBRARY", ("com.android.library", "com.android.dynamic-feature")),
    ("JVM_LIBRARY", ("org.jetbrains.kotlin.jvm", "java-library", "java")),
)
# Labels and colours of module types.
TYPE_LABELS = {
    "KMP": ("KMP", "#9B59B6"), "KMP_ANDROID_LIBRARY": ("KMP Android Lib", "#1ABC9C"), "ANDROID_APP": ("Android App", "#3498DB"),
    "ANDROID_LIBRARY": ("Android Lib", "#2ECC71"), "JVM_LIBRARY": ("JVM Lib", "#27AE60"), "UNKNOWN": ("Unknown", "#95A5A6"),
}
MODULE_TYPES = tuple(TYPE_LABELS)
SEVERITIES = ("ERROR", "WARNING", "INFO")
SARIF_LEVELS = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    return F.coalesce(reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), reversed(values.items()), F.lit(None)), F.lit(default))


def type_label(module_type: Column) -> Column:
    return lookup({k: v[0] for k, v in TYPE_LABELS.items()}, module_type)


def type_color(module_type: Column) -> Column:
    return lookup({k: v[1] for k, v in TYPE_LABELS.items()}, module_type)


# ------------------------------------------------------------ configurations
def is_api(configuration: Column) -> Column:
    return configuration == "api"


def is_test(configuration: Column) -> Column:
    return F.contains(F.lower(configuration), F.lit("test"))


def is_compile_only(configuration: Column) -> Column:
    return F.contains(F.lower(configuration), F.lit("compileonly"))


def is_captured(configuration: Column) -> Column:
    """Listed configurations, and those that belong to a source set."""
    return configuration.isin(*PRODUCTION_CONFIGS, *TEST_CONFIGS) | configuration.rlike(f"({'|'.join(SUFFIXES)})$")


def source_set(configuration: Column) -> Column:
    """What stands before a suffix; null for standard configurations and where nothing does."""
    has_suffix = configuration.rlike(f"({'|'.join(SUFFIXES)})$")
    return F.when(~configuration.isin(*STANDARD_CONFIGS) & has_suffix, F.nullif(F.regexp_replace(configuration, f"({'|'.join(SUFFIXES)})$", ""), F.lit("")))


def live_source_set(configuration: Column) -> Column:
    """What stands before a suffix, whatever the configuration; null where nothing does."""
    ending = f"({'|'.join(SUFFIXES)})$"
    return F.when(configuration.rlike(ending), F.nullif(F.regexp_replace(configuration, ending, ""), F.lit("")))


def split_dependency(raw: Column) -> tuple[Column, Column]:
    """``configuration:target`` at its first colon; both null without one."""
    at = F.instr(raw, ":")
    found = at > 0
    return F.when(found, F.substring(raw, F.lit(1), at - 1)), F.when(found, F.substring(raw, at + 1, F.length(raw)))


# ---------------------------------------------------------------------- paths
def segments(path: Column) -> Column:
    return F.filter(F.split(path, ":"), lambda s: F.trim(s) != "")


def short_name(path: Column) -> Column:
    return F.substring_index(path, ":", -1)


def path_tags(path: Column) -> Column:
    """Segments but the last, each once."""
    s = segments(path)
    return F.array_distinct(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))


def build_dir(path: Column) -> Column:
    return F.replace(F.ltrim(path, F.lit(":")), F.lit(":"), F.lit("/"))


def detect_type(plugin_classes: Column) -> Column:
    """By plugin class names; the first entry with a substring in any of them holds."""
    names = F.array_join(plugin_classes, " ")
    out = F.lit("UNKNOWN")
    for kind, parts in reversed(TYPE_BY_CLASS):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(names, F.lit(p)) for p in parts)), kind).otherwise(out)
    return out


def detect_type_by_id(plugin_ids: Column) -> Column:
    out = F.lit("UNKNOWN")
    for kind, ids in reversed(TYPE_BY_ID):
        out = F.when(F.arrays_overlap(plugin_ids, F.array(*map(F.lit, ids))), kind).otherwise(out)
    return out


# ---------------------------------------------------------------------- globs
def _clean(path: str) -> list[str]:
    return [s for s in path.split(":") if s.strip()]


def glob_regex(pattern: str) -> str:
    """A glob over ``:``-separated segments as a regular expression on ``:a:b`` (``*``: one segment, ``**``: any number)."""
    quoted = lambda s: "".join(c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c for c in s)
    parts = {"*": ":[^:]+", "**": "(?::[^:]+)*"}
    return "^" + "".join(parts.get(s) or ":" + quoted(s) for s in _clean(pattern)) + "$"


def glob_subject(path: Column) -> Column:
    return F.array_join(F.transform(segments(path), lambda s: F.concat(F.lit(":"), s)), "")


def glob_match(path: Column, pattern: str) -> Column:
    return glob_subject(path).rlike(glob_regex(pattern))


def glob_any(path: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return glob_subject(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def first_match(path: Column, named: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first entry with a matching pattern, in the given order; null without one."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(named):
        out = F.when(glob_any(path, patterns), name).otherwise(out)
    return out


def glob_test(pattern: str, path: str) -> bool:
    """The same test on the driver."""
    return re.search(glob_regex(pattern), "".join(":" + s for s in _clean(path))) is not None


# ------------------------------------------------------------------- escaping
def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def xml_escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def html_escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def json_escape(text: Column) -> Column:
    return _replaced(text, (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))
