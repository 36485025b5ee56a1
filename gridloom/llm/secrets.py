"""Secrets in texts, with built-in functions only.

Base kinds are patterns: assignments to names of secrets, access keys, long hex
strings. The randomness battery looks at every run of 20 or more token characters:

* the encoding is inferred (hex, base 32, 36, 26 or 64), which gives an alphabet of k symbols;
* the chi-squared statistic of uniformity over that alphabet, the runs test about the alphabet's middle and the lag-1 serial
  correlation each must fail to reject a random string at ``ALPHA_Z``;
* the same chi-squared statistic must reject ordinary text. For text it is about noncentral chi-squared, with a noncentrality
  of n times what the encoding's letter frequencies give; its lower tail is the p-value. It is length-aware by itself: short runs, or small alphabets,
  can't reach a small one.

A run that one of the three tests rejects has the p-value 1, so it counts as a hypothesis but is never found; what is left is a p-value of
ordinary text still. All p-values of the table, weighted by length, go through Benjamini and Hochberg's step-up at ``RATE``: a first pass
counts them in bins of their logarithm, ``BINS`` a factor of ten, the driver finds the last bin whose upper border the step-up accepts, and the second
pass takes the runs up to there. So the share of false finds is held over the table, not document by document.

A discovery is a span of kind ``random``, unless a base span overlaps it.
Everything is done within a row, but for that one count of some thousand bins at most: no other shuffle.

Null texts count as empty: no spans. Repeated rows are scanned each on its own; spans of one start stand by kind.
Other columns stay, and a column of an output's name is replaced. Empty tables give empty tables. In texts with many matches the
work grows with the square root of their number at most, times the text: they are walked in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ready

KINDS = ("assign", "access", "hex", "random")
RANDOM_RUN = "[A-Za-z0-9+/_=-]{20,}"
ALPHA_Z = 3.29  # two-sided 0.001 in each test of the battery
RATE = 0.01
BINS = 20

# Sum of squared frequencies of symbols in ordinary text of each encoding: 0.0655 is that of English letters, 0.1 that of digits.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS: tuple[tuple[str, str, float], ...] = (
    ("^[0-9]+$", "", 0.0),  # plain numbers are no secrets
    ("^[0-9a-f]+$", _DIGITS + "abcdef", 0.1),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.1),
    ("^[a-z]+$", _LOWER, 0.0655),
    ("^[A-Z]+$", _UPPER, 0.0655),
    ("^[A-Z2-7]+$", _UPPER + "234567", 0.0655),
    ("^[A-Z0-9]+$", _UPPER + _DIGITS, 0.0655),
    ("^[a-z0-9]+$", _LOWER + _DIGITS, 0.0655),
    ("", _UPPER + _LOWER + _DIGITS + "+/", 0.0655),
)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the class has the least length exactly if it matches with that length as a minimum.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Items up to which an array is walked at once; longer ones go by blocks of the square root of their number.
AT_ONCE = 64


def _blocks(items: Column) -> Column:
    """A long array in blocks."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    return _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.size(items) - 1, n), lambda at: F.slice(items, at + 1, n)))


def _before(values: Column, how) -> Column:
    """For each value what ``how`` makes of those before it, from 0 on."""
    none = F.array().cast("array<int>")
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct(how(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _places(text: Column, found: Column, pattern: str) -> Column:
    """Start and end, in code points, of the matches ``found``: text between matches and matches take turns."""
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.char_length(b).alias("b"), F.char_length(m).alias("m")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def walked(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), none.alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["b"] + x["m"]).alias("at"),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + x["m"]).alias("end")))).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    def by_blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["b"] + x["m"]))
        return F.flatten(F.zip_with(parts, _before(totals, lambda at, n: at + n), walked))

    long = _let(sizes, lambda x: _let(_blocks(x), by_blocks))
    return F.when(F.size(found) == 0, none).when(F.size(found) <= AT_ONCE, walked(sizes, F.lit(0))).otherwise(long)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution (Abramowitz and Stegun 26.2.17, error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """Struct of ``n``, ``k``, the tests' ``uniform``, ``runs``, ``serial`` (standard normal if random) and ``p`` (of ordinary text); null for plain numbers."""
    symbols = F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+/")

    def tests(x: Column, alphabet: Column, squares: Column) -> Column:
        n, k = F.char_length(x).cast("double"), F.char_length(alphabet).cast("double")
        counts = F.transform(F.split(alphabet, ""), lambda c: (F.char_length(x) - F.char_length(F.replace(x, c, F.lit("")))).cast("double"))
        total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        known = F.struct(n.alias("n"), k.alias("k"), (k / n * total - n).alias("chi"), codes.alias("codes"), squares.alias("squares"))
        return _let(known, lambda v: _let(added(v), lambda sums: finish(v, sums)))

    def added(v: Column) -> Column:
        """Sums over the codes; what goes into a function of elements is never itself an aggregate, so this is linear."""
        codes, half = v["codes"], v["k"] / 2
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        over = lambda items, term: F.aggregate(items, F.lit(0.0), lambda s, x: s + term(x))
        return F.struct(
            over(codes, lambda c: F.when(c >= half, 1.0).otherwise(0.0)).alias("upper"), over(codes, lambda c: c).alias("sum"), over(codes, lambda c: c * c).alias("squared"),
            over(pairs, lambda q: F.when((q["a"] >= half) != (q["b"] >= half), 1.0).otherwise(0.0)).alias("changes"), over(pairs, lambda q: q["a"] * q["b"]).alias("products"),
        )

    def finish(v: Column, sums: Column) -> Column:
        n, k, chi, codes = v["n"], v["k"], v["chi"], v["codes"]
        df = k - 1
        uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        excess = n * (k * v["squares"] - 1)
        p = normal_cdf((chi - (df + excess)) / F.sqrt(2 * (df + 2 * excess)))
        upper, changes = sums["upper"], sums["changes"] + 1
        expected = 1 + 2 * upper * (n - upper) / n
        runs = F.when((upper == 0) | (upper == n), F.lit(-9.0)).otherwise((changes - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9))))
        mean = sums["sum"] / n
        spread = sums["squared"] - n * mean * mean
        along = sums["products"] - mean * (2 * sums["sum"] - codes[0] - F.element_at(codes, -1)) + (n - 1) * mean * mean
        serial = F.when(spread <= 1e-9 * n, F.lit(9.0)).otherwise((along / spread + 1 / n) * F.sqrt(n))
        return F.struct(n.alias("n"), k.alias("k"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), p.alias("p"))

    def encoded(x: Column) -> Column:
        alphabet, squares = F.lit(ENCODINGS[-1][1]), F.lit(ENCODINGS[-1][2])
        for pattern, letters, square in reversed(ENCODINGS[:-1]):
            alphabet = F.when(x.rlike(pattern), letters).otherwise(alphabet)
            squares = F.when(x.rlike(pattern), square).otherwise(squares)
        return F.struct(x.alias("x"), alphabet.alias("alphabet"), squares.alias("squares"))

    return _let(symbols, lambda x: _let(encoded(x), lambda e: F.when((e["alphabet"] != "") & (F.char_length(e["x"]) >= 16), tests(e["x"], e["alphabet"], e["squares"]))))


def _judged(token: Column) -> Column:
    """The bin of a token's p-value by its length, or -1 if a test of the battery rejects it, and its length; null if nothing is tested."""

    def binned(t: Column) -> Column:
        random = (t["uniform"] < ALPHA_Z) & (F.abs(t["runs"]) < ALPHA_Z) & (F.abs(t["serial"]) < ALPHA_Z)
        p = F.greatest(t["p"] / t["n"], F.lit(1e-300))
        return F.when(t.isNotNull(), F.struct(F.when(random, F.floor(-F.log10(p) * BINS)).otherwise(F.lit(-1)).cast("int").alias("bin"), t["n"].alias("n")))

    return _let(battery(token), binned)


def accepted_bin(bins: Sequence[tuple[int, int, float]], rate: float = RATE) -> int | None:
    """The lowest bin that the step-up accepts, of (bin, number, sum of lengths); bins hold p-values divided by lengths."""
    tests, mean = sum(n for _, n, _ in bins), sum(x for _, _, x in bins) / max(1, sum(n for _, n, _ in bins))
    found, best = 0, None
    for at, n, _ in sorted(bins, reverse=True):
        found += n
        if at >= 0 and 10 ** (-at / BINS) * mean <= rate * found / tests:
            best = at
    return best


def _labelled(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end) in code points, by start, then kind (its number in ``KINDS``).

    The p-values of the table are counted at once.
    """
    ready(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("base_spans", "spans")]
    t = F.col("`\u0001t`")
    runs = F.transform(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(RANDOM_RUN), 0), _judged)
    tests = docs.select(F.explode(runs).alias("x")).where("x is not null").groupBy("x.bin").agg(F.count("*"), F.sum("x.n"))
    limit = accepted_bin([tuple(r) for r in tests.collect()])
    found = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM_RUN}
    out = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("\u0001t"))
    out = out.withColumns({f"\u0001m_{k}": F.regexp_extract_all(t, F.lit(p), 0) for k, p in found.items()})
    out = out.withColumns({f"\u0001s_{k}": _places(t, F.col(f"`\u0001m_{k}`"), p) for k, p in found.items()})
    long_enough = F.zip_with(F.col("`\u0001s_assign`"), F.col("`\u0001m_assign`"), lambda s, m: F.struct(s.alias("s"), (F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("ok")))
    assign = F.transform(F.filter(long_enough, lambda x: x["ok"]), lambda x: x["s"])
    base = F.array_sort(F.concat(_labelled(assign, 0), _labelled(F.col("`\u0001s_access`"), 1), _labelled(F.col("`\u0001s_hex`"), 2)))
    out = out.withColumn("base_spans", base)
    judged = F.zip_with(F.col("`\u0001s_random`"), F.col("`\u0001m_random`"), lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), _judged(m)["bin"].alias("bin")))
    random = F.filter(judged, lambda s: s["bin"] >= limit) if limit is not None else F.filter(judged, lambda s: F.lit(False))
    free = F.filter(random, lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", _labelled(free, 3))))
    return out.select(*(F.col(f"`{c}`") for c in keep), "base_spans", "spans")


def written_spans(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or each stretch of overlapping spans, replaced by a mark; ``spans`` are in order."""

    def cut(part: Column, whole: Column, base: Column) -> Column:
        """``whole``, which starts at ``base`` and ends with the last of the spans in ``part``."""
        step = lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(whole, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")),
        ).otherwise(acc)
        return F.aggregate(part, F.struct(base.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def by_blocks(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda s: s["end"])))
        from_to = F.zip_with(_before(ends, F.greatest), ends, lambda a, b: F.struct(a.alias("a"), F.greatest(a, b).alias("b")))
        pieces = F.zip_with(parts, from_to, lambda p, x: _let(F.substring(text, x["a"] + 1, x["b"] - x["a"]), lambda whole: cut(p, whole, x["a"])))
        return F.array_join(pieces, "")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    head = F.when(F.size(spans) <= AT_ONCE, cut(spans, text, F.lit(0))).otherwise(_let(_blocks(spans), by_blocks))
    return F.when(F.size(spans) > 0, F.concat(head, F.substring(text, last + 1, F.lit(2**31 - 1)))).otherwise(text)
