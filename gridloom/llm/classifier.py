"""Document quality by Bradley-Terry ranking.

A document's score is linear in features of its text. From pairs of a better and a worse labelled
document the weights are learnt by logistic loss on the difference of features: the chance that the better one wins is
the logistic function of the difference of scores. The threshold is the quantile of the training scores
below which the share of the worse label lies. It is put at ``CUT`` of the output's scale.

All labelled rows that may be learnt from count: for means and scales, in pairs, and for the threshold. They are dealt into groups of about ``BLOCK`` rows of
each label by a hash of the id; rows of the rarer label are in as many groups as it takes, so both are in each. In its group each row meets ``PARTNERS`` rows of the other label or more,
which ones the order of hashes says. Executors add up what each step of the fit and each search for a quantile needs; the driver gets one row of sums a task.
Labels, language, source and id are no features.

Null texts count as empty and are scored like any other. Label rows with a null id, or another label than 0 and 1, are not used;
of an id labelled twice the smaller label holds, and of an id with several texts the one of smallest features is learnt from. Without both labels there is nothing to rank: every score is 0.5.
Empty tables give empty tables. Repeated rows are scored each. ``classify`` keeps other columns; ``text`` goes, and a column of an output's name is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gridloom.llm.common import numbered, ready, temporary, utf8, written
from gridloom.llm.quality_rules import Features

#: Rows of a label in a group, about.
BLOCK = 2048
#: Rows of the other label that a row meets at least.
PARTNERS = 16
#: Bins of a search for quantiles, and how often one is cut into so many.
BINS, CUTS = 1024, 4
CUT = 0.7

NAMES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "exclamations", "bars", "stops", "commas", "distinct", "repeated_windows", "duplicate_lines", "top_word", "echoes", "line_words", "short_words", "marked_words",
)


def _without(keep: bytes) -> bytes:
    return bytes(i for i in range(256) if i not in keep)


_DIGITS, _MARKS, _BARS, _STOPS, _COMMAS = map(_without, (b"0123456789", b"!?", b"|", b".", b","))


def features(text: bytes) -> list[float]:
    """Rates by word, by character in words or by line, squeezed so that none runs away."""
    f = Features(text)
    n = f.n_words
    if not n:
        return [0.0] * len(NAMES)
    chars, w = max(1, f.word_chars), f.words
    count = Counter(w)
    rate = lambda drop: len(text.translate(None, drop)) / n
    echoes = sum(map(bytes.__eq__, w, w[1:]))
    raw = [
        np.log1p(n), np.log(chars / n), f.n_symbols / n, f.n_upper / chars, rate(_DIGITS), rate(_MARKS), rate(_BARS), rate(_STOPS), rate(_COMMAS), len(count) / n, f.n_repeat_words / n, f.n_dup_lines / max(1, f.n_lines), max(count.values()) / n, echoes / n,
        np.log1p(n / max(1, f.n_lines)), sum(map((3).__gt__, map(len, w))) / n, sum(not x[-1:].isalpha() and x[-1] < 128 for x in w) / n,
    ]
    return [float(min(x, 12.0)) for x in raw]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _widened((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, with the threshold at ``CUT``."""
        z = np.clip(self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def _widened(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.concatenate((z, np.abs(z), z * z / 8), axis=1)


#: Adds up to something over all groups: reads the features of a group's rarer and commoner rows, and whether its rarer ones count here.
Part = Callable[[np.ndarray, np.ndarray, bool], np.ndarray]


def _summed(groups: DataFrame, part: Part) -> np.ndarray:
    """The sum of ``part`` over all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rare, common, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = part(*(np.frombuffer(b, np.float64).reshape(-1, len(NAMES)) for b in (rare, common)), own)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = groups.select("rare", "common", "own").mapInArrow(run, "sums array<double>").collect()
    return np.array([math.fsum(c) for c in zip(*(r.sums for r in rows), strict=True)])


def _partners(n_rare: int, n_common: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's rows in which each row meets ``PARTNERS`` of the other label, or more, or the same ones again if there are fewer."""
    if not n_rare or not n_common:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.arange(max(n_rare, n_common))
    shifts = np.arange(PARTNERS) * n_rare // PARTNERS
    return np.concatenate([(i + s) % n_rare for s in shifts.tolist()]), np.tile(i % n_common, PARTNERS)


def _groups(labelled: DataFrame, rare: int, n_rare: int, n_common: int) -> DataFrame:
    """``labelled`` (id, y, features) dealt into groups ``(rare, common, own)``: features end to end; a rarer row counts where ``own`` is set, in one group."""
    blocks = -(-n_rare // BLOCK)
    copies = -(-n_common // (blocks * BLOCK))
    hashed = labelled.withColumn("hash", F.xxhash64("id"))
    at = F.pmod("hash", F.lit(blocks)) * copies
    common = hashed.where(F.col("y") != rare).withColumn("key", at + F.pmod(F.xxhash64("hash"), F.lit(copies)))
    dealt = hashed.where(F.col("y") == rare).withColumn("key", F.explode(F.sequence(at, at + copies - 1))).unionByName(common)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hash", "ascending")])
        x = np.array(group["features"].combine_chunks().flatten()).reshape(-1, len(NAMES))
        of_rare = group["y"].to_numpy() == rare
        columns = [[x[of_rare].tobytes()], [x[~of_rare].tobytes()], [group["key"][0].as_py() % copies == 0]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["rare", "common", "own"])

    return dealt.select("key", "hash", "y", "features").groupBy("key").applyInArrow(pack, "rare binary, common binary, own boolean")


def _ranked(groups: DataFrame, raw: Callable[[np.ndarray], np.ndarray], wanted: list[tuple[bool, bool, int]], bound: float) -> list[float]:
    """The scores, within ``bound``, that have so many below them: whether rarer and commoner rows count, and how many."""
    brackets = [(-bound, bound)] * len(wanted)
    for _ in range(CUTS):
        edges = [np.linspace(low, high, BINS + 1) for low, high in brackets]

        def count(rare: np.ndarray, common: np.ndarray, own: bool, edges: list[np.ndarray] = edges) -> np.ndarray:
            s = [raw(rare if own else rare[:0]), raw(common)]
            return np.concatenate([sum(np.bincount(np.searchsorted(e, x, side="right"), minlength=BINS + 2) for x, counts in zip(s, (a, b), strict=True) if counts) for e, (a, b, _) in zip(edges, wanted, strict=True)])

        found = _summed(groups, count).reshape(len(wanted), -1).cumsum(axis=1)
        at = [min(max(1, int(np.searchsorted(f, k, side="right"))), BINS) for f, (_, _, k) in zip(found, wanted, strict=True)]
        brackets = [(float(e[b - 1]), float(e[b])) for e, b in zip(edges, at, strict=True)]
    return [(low + high) / 2 for low, high in brackets]


def fit(groups: DataFrame, rare: int, n_rare: int, n_common: int, ridge: float = 1e-3) -> Ranker:
    """Newton's method on the logistic loss of the groups' pairs; ``rare``: the label of the rarer rows."""

    def moments(rare: np.ndarray, common: np.ndarray, own: bool) -> np.ndarray:
        x = np.concatenate((rare if own else rare[:0], common))
        return np.concatenate((x.sum(axis=0), (x * x).sum(axis=0)))

    n, sums = n_rare + n_common, _summed(groups, moments)
    mean = sums[: len(NAMES)] / n
    scale = np.maximum(np.sqrt(np.maximum(sums[len(NAMES) :] / n - mean * mean, 0)), 1e-6)
    sign = 1 if rare == 1 else -1
    w = np.zeros(3 * len(NAMES))
    for _ in range(25):

        def step(rare: np.ndarray, common: np.ndarray, own: bool, w: np.ndarray = w) -> np.ndarray:
            a, b = (_widened((x - mean) / scale) for x in (rare, common))
            i, j = _partners(len(a), len(b))
            gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for lo in range(0, len(i), 8192):
                d = sign * (a[i[lo : lo + 8192]] - b[j[lo : lo + 8192]])
                p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance of the wrong order
                gradient += d.T @ p
                hessian += (d * (p * (1 - p))[:, None]).T @ d
            return np.concatenate(([len(i)], gradient, hessian.reshape(-1)))

        sums = _summed(groups, step)
        gram = np.eye(len(w)) * ridge * max(1, sums[0])
        change = np.linalg.solve(gram + sums[1 + len(w) :].reshape(len(w), -1), gram @ w - sums[1 : 1 + len(w)])
        w = w - change
        if np.abs(change).max() < 1e-6:
            break
    model = Ranker(mean, scale, w, 0.0, 1.0)
    n_bad = n_common if rare == 1 else n_rare
    below, part = divmod(n_bad * (n - 1), n)  # rows between which the share of the worse label ends
    wanted = [(True, True, below), (True, True, below + 1), (True, False, (n_rare - 1) // 2), (False, True, (n_common - 1) // 2)]
    low, high, of_rare, of_common = _ranked(groups, model.raw, wanted, 8 * float(np.abs(w).sum()) + 1)
    return Ranker(mean, scale, w, low + (high - low) * part / n, float(4 / max(1e-3, sign * (of_rare - of_common))))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``features`` (array<double>); ``train`` and ``classify`` take that column for a text."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "features")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in utf8(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return numbered(source).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep), F.array(F.lit(0.0)).alias("features")).schema)


def _has_features(docs: DataFrame, text: str) -> bool:
    return isinstance(docs.schema[text].dataType, ArrayType)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Ranker | None:
    """``allowed``: which ids (column ``id``) may be learnt from. ``text`` may be a column of features. None without both labels."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & allowed)
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull() & allowed)
    some = some.withColumnRenamed("text", "features") if _has_features(docs, text) else with_features(some)
    with temporary(ready(docs.sparkSession)):
        labelled = written(some.join(rows, "id").groupBy("id").agg(F.min("features").alias("features"), F.first("y").alias("y")), "labelled")
        counts = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
        if len(counts) < 2:
            return None
        rare = min(counts, key=lambda y: (counts[y], y))
        sizes = rare, counts[rare], counts[1 - rare]
        return fit(written(_groups(labelled, *sizes), "groups"), *sizes)


def classify(docs: DataFrame, model: Ranker | None, text: str = "text") -> DataFrame:
    """``docs`` without the text, or the column of features, with ``score`` (double, 0 to 1) and ``predicted`` (int: 1 from ``CUT`` on)."""
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "score", "predicted")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("\u0001text"))
    ready_made = _has_features(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.num_columns - 1)
            if model is None:
                s = np.full(len(given), 0.5)
            else:
                x = np.array(given.flatten()) if ready_made else np.array([features(t) for t in utf8(given)])
                s = model.scores(x.reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    return numbered(source).mapInArrow(run, docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
