"""Quality rules as a short-circuit cascade.

Each rule is a predicate over lazily computed features of a text. On a bounded
sample the driver times every rule and counts what it rejects, and the cascade
runs the rules by rejections per second, highest first; a text leaves at its
first failure. The order changes the cost alone: a text passes if it passes
every rule, so the verdict does not depend on timings.

Null or empty texts have no words and fail the length rule. Repeated rows are
judged each on its own. Other columns are kept; a column of an output's name is
replaced. Empty tables give empty tables, with the rules in declared order. Texts are judged one at a time, whole; those over 1 MB are only left out
of the timing. The timing sample comes from the first partitions that give it: a full pass over the texts would cost more than a better order spares.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, ready, utf8

SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(i for i in range(256) if i not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


class Features:
    """What rules look at, each computed once and only if asked for."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that are neither white space nor continuation bytes."""
        return len(self.text.translate(None, b" \t\n\v\f\r" + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text.translate(None, _KEEP_SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        """ASCII capitals."""
        return len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.text.split(b"\n") if x.split())

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        lines = [x for x in self.text.split(b"\n") if not x.isspace() and x]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that stand twice or more in the text."""
        w = self.words
        if len(w) < 4:
            return 0
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = {k for k, n in Counter(windows).items() if n > 1}
        covered, until = 0, 0
        for i, x in enumerate(windows):
            if x in often:
                covered += i + 3 - max(until, i)
                until = i + 3
        return covered

    @cached_property
    def top_word_share(self) -> float:
        return max(Counter(self.words).values()) / self.n_words if self.n_words else 0.0


@dataclass(frozen=True)
class Rule:
    """``fails`` is given the features and says whether the text is rejected."""

    name: str
    fails: Callable[[Features], bool]


#: The rules of common web-text filters; ratios are of words, or of characters in words.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda f: f.n_words < 50),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 10 * f.n_dup_lines > 3 * f.n_lines),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 14 * f.n_words),
    Rule("capitals", lambda f: 2 * f.n_upper > f.word_chars),
    Rule("one_word", lambda f: f.top_word_share > 0.3),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int


def measure(rules: Sequence[Rule], sample: Sequence[bytes]) -> list[Measured]:
    """Seconds and rejections of each rule alone on the sample."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(bool(rule.fails(Features(t))) for t in sample)
        out.append(Measured(rule, time.perf_counter() - began, rejected))
    return out


def cascade(measured: Sequence[Measured]) -> list[Rule]:
    """Rules by rejections per second; of equal ones the declared order stays."""
    return [m.rule for m in sorted(measured, key=lambda m: -m.rejected / max(m.seconds, 1e-9))]


def sample_texts(docs: DataFrame, text: str = "text", rows: int = 500, fraction: float = 0.05, longest: int = 1 << 20) -> list[bytes]:
    """At most ``rows`` texts (a seeded sample of the first partitions that give them), for timing only."""
    x = docs.select(F.col(f"`{text}`").cast("binary").alias("t")).where(F.octet_length("t") <= longest)
    got = [bytes(r.t) for r in x.sample(fraction, seed=7).limit(rows).collect()]
    return got or [bytes(r.t) for r in x.limit(rows).collect()]


def first_failure(order: Sequence[Rule], features: Features) -> str | None:
    return next((r.name for r in order if r.fails(features)), None)


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text", stats: Sequence[str] = (), sample_rows: int = 500) -> DataFrame:
    """``docs`` with ``kept`` (boolean) and a long column for each named feature in ``stats``."""
    ready(docs.sparkSession)
    order = cascade(measure(rules, sample_texts(docs, text, sample_rows)))
    keep = [c for c in docs.columns if c not in {"kept", *stats}]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), *(F.lit(0).cast("long").alias(s) for s in stats), F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = [], [[] for _ in stats]
            for t in utf8(batch.column(batch.num_columns - 1)):
                f = Features(t)
                kept.append(first_failure(order, f) is None)
                for s, v in zip(stats, values, strict=True):
                    v.append(getattr(f, s))
            columns = [*batch.columns[:-1], *(pa.array(v, pa.int64()) for v in values), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *stats, "kept"])

    return numbered(source).mapInArrow(run, schema)
