"""op4, op5 and op7 against brute force or held-out figures, and the edge cases of their operators."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import classifier, exchange, lm, queries, substring

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t\n\v\f\r]+")
ODD = [None, "", " \n\t ", "a", "x" * 5000, "ab " * 3000, "Ünï ça 日本語 😀", "same", "same"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_packing():
    rng = np.random.default_rng(0)
    for dtype in (np.uint64, np.uint32, np.uint8):
        a, b = rng.integers(0, 200, 1000).astype(dtype), np.zeros(0, dtype)
        x, y = exchange.unpack(exchange.pack(a, b))
        assert (x == a).all() and len(y) == 0


def brute_lm(docs):
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    score = {d: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for d, ws in tokens.items()}
    return {d: (out[d], len(ws), sum(c[w] > 0 for w in ws), n, score[d]) for d, ws in tokens.items()}


def test_op4(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_lm(docs)
    got = {r.doc_id: r for r in queries.op4_lm_score(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, (out, tokens, known, n, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, tokens, known, n)
        assert abs(r.base_score - base) <= 1e-9 * abs(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20000).astype(np.uint64) << np.uint64(1)
    counts = rng.zipf(1.5, 20000).clip(1, 10**6)
    edges = exchange.by_segment(keys_sorted := np.sort(keys), 8)
    order = np.argsort(keys)
    parts = [(s, *lm.build_filter(keys_sorted[edges[s] : edges[s + 1]], counts[order][edges[s] : edges[s + 1]])) for s in range(8)]
    f = lm.Filter(parts, 8)
    got = f.counts(keys)
    assert (got >= lm.count_of(lm.level_of(counts))).all()  # a filter only ever reads too much
    assert (got == lm.count_of(lm.level_of(counts))).mean() > 0.97
    assert (f.counts(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.02
    assert lm.count_of(np.array([0, 1])).tolist() == [0, 1]


def test_lm_edges(docs_of):
    rows = lm.score(docs_of(ODD).withColumn("score", F.lit("clash")), lm.crc_is(1, 5)).orderBy("doc_id").collect()
    want = brute_lm(list(enumerate(ODD)))
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [want[i][:4] for i in range(len(ODD))]
    assert lm.score(docs_of(ODD).where("false"), lm.crc_is(1, 5)).count() == 0
    alone = lm.score(docs_of(ODD), lambda i: True).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)
    null = docs_of(ODD).withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.held_out for r in lm.score(null, lm.crc_is(1, 5)).collect()} == {False}


def test_lm_keeps_every_bigram(docs_of):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60)) for _ in range(60)]
    small = {"capacity": 64} if "capacity" in inspect.signature(lm.score).parameters else {}  # a bound that dropped rare bigrams of larger corpora
    got = {r.doc_id: r.score for r in lm.score(docs_of(texts), lm.crc_is(1, 5), **small).collect()}
    tokens = {i: [*t.split(), None] for i, t in enumerate(texts)}
    trained = [ws for i, ws in tokens.items() if not lm.crc_is(1, 5)(i)]
    one = Counter(w for ws in trained for w in ws)
    two = Counter(p for ws in trained for p in zip(["^", *ws], ws))
    n, v = sum(one.values()), len(one)
    read = lambda k: float(lm.count_of(lm.level_of(np.array([k])))[0]) if k else 0.0
    off = []
    for i, ws in tokens.items():
        want = 0.0
        for a, b in zip(["^", *ws], ws):
            before = len(trained) if a == "^" else one[a]
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            want += math.log10((min(read(two[a, b]), before, one[b]) + lm.STRENGTH * p) / (before + lm.STRENGTH))
        off.append(abs(got[i] - want) / len(ws))
    assert sum(off) / len(off) < 0.01 and max(off) < 0.05  # what a filter reads too much


def test_lm_probabilities_sum_to_one():
    """After each word, over all words and the end, with counts as a filter keeps them."""
    rng = random.Random(9)
    texts = [[*(f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(80)), None] for _ in range(150)]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(["^", *t], t))
    n, v = sum(one.values()), len(one)
    keys = {(a, b): np.uint64(rng.getrandbits(64)) for a in ["^", *one] for b in one}
    seen = sorted(two, key=lambda p: keys[p])
    kept = lm.Filter([(0, *lm.build_filter(np.array([keys[p] for p in seen], np.uint64), np.array([two[p] for p in seen])))], 1)
    sums = []
    for a in ["^", *(w for w in one if w is not None)]:
        before = len(texts) if a == "^" else one[a]
        read = kept.counts(np.array([keys[a, b] for b in one], np.uint64))
        read = np.minimum(read, np.minimum(before, np.array([one[b] for b in one])))
        unseen = 0.5 / (n + 0.5 * (v + 1))  # what unigrams leave to words that were never seen
        sums.append(sum((r + lm.STRENGTH * (one[b] + 0.5) / (n + 0.5 * (v + 1))) / (before + lm.STRENGTH) for b, r in zip(one, read)) + lm.STRENGTH * unseen / (before + lm.STRENGTH))
    # false positives: of so many pairs never seen a hundredth counts one
    slack = 0.02 * len(one) / lm.STRENGTH
    assert all(0.75 <= s <= 1.25 + slack for s in sums) and abs(sum(sums) / len(sums) - 1) < 0.1 + slack
    assert lm.count_of(lm.level_of(np.array([2**62]))) > 2**61  # no ceiling


def brute_repeats(docs, window=50):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_op5(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op5_substring_dedup(spark, SF).collect())
    assert got == brute_repeats(docs) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("window", [50, 7, 2])
def test_repeats_shifted_and_overlapping(docs_of, window, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 2000)
    rng = random.Random(window)
    pool = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.randint(window, 3 * window))] for k in range(4)]
    texts = []
    for i in range(50):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += [f"d{i}x{rng.randrange(5)}" for _ in range(rng.randint(0, 40))] + p[a:]
        texts.append(" ".join(w))
    texts += [*ODD, "q " * 300, "q " * 120, " ".join(pool[0]), " ".join(pool[0])]
    docs = docs_of(texts)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeats(docs, window=window).collect())
    assert got == brute_repeats(list(enumerate(texts)), window)


def test_repeats_edges(docs_of, spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (3, text), (3, text), (-1, text), (9, "pre " + text + " post")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.removed]) for r in substring.remove_repeats(df).collect()}
    assert got == {None: (0, []), 3: (80, [(0, 80)]), -1: (0, []), 9: (80, [(1, 81)])}
    assert substring.remove_repeats(df.where("false")).count() == 0


def test_op7(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_quality_classifier(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    accuracy = np.mean([p == y for _, p, y in held])
    print("held out", len(held), "auc", auc, "accuracy", accuracy)
    assert auc > 0.95 and accuracy > 0.93


def test_classifier_edges(docs_of, spark):
    docs = docs_of(ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, 0), (5, 1), (None, 1), (7, None), (8, 3), (99, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels, F.lit(True))
    rows = classifier.classify(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert classifier.train(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in classifier.classify(docs, None).collect()} == {0.5}
    assert classifier.classify(docs.where("false"), model).count() == 0
    assert classifier.train(docs.where("false"), labels, F.lit(True)) is None


def test_classifier_learns_from_all_labelled_rows(spark):
    docs = spark.range(22_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), F.col("id") % 50 + 9)).alias("text"))
    last = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id").desc()).limit(1_500).collect()]
    bad = F.col("doc_id").isin(last)  # all labels of one kind are beyond the first 20,000 rows by hash
    docs = docs.withColumn("text", F.when(bad, F.concat("text", F.lit(" ! ! ! !"))).otherwise(F.col("text")))
    model = classifier.train(docs, docs.select("doc_id", (~bad).cast("int").alias("quality")), F.lit(True))
    assert model is not None
    rows = classifier.classify(docs, model).collect()
    assert all(r.predicted == (r.doc_id not in set(last)) for r in rows[:200] + [r for r in rows if r.doc_id in last[:200]])
    assert len(rows) == 22_000


def test_classifier_groups_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(classifier, "BLOCK", 16)
    rng = np.random.default_rng(2)
    n_rare, n_common = 40, 700
    x = rng.normal(size=(n_rare + n_common, len(classifier.NAMES)))
    rows = [(i, int(i >= n_rare), f) for i, f in enumerate(x.tolist())]
    labelled = spark.createDataFrame(rows, "id long, y int, features array<double>")
    groups = classifier._groups(labelled, 0, n_rare, n_common).cache()
    assert 30 <= groups.count() <= 45
    firsts = lambda b: [f[0] for f in np.frombuffer(b).reshape(-1, len(classifier.NAMES))]
    got = groups.collect()
    assert sorted(v for g in got for v in firsts(g.common)) == sorted(x[n_rare:, 0])
    assert sorted(v for g in got if g.own for v in firsts(g.rare)) == sorted(x[:n_rare, 0])
    for a, b in ((3, 40), (40, 3), (16, 16), (1, 1)):
        i, j = classifier._partners(a, b)
        assert min(np.bincount(i, minlength=a)) >= classifier.PARTNERS and min(np.bincount(j, minlength=b)) >= classifier.PARTNERS
        assert len(set(zip(i.tolist(), j.tolist()))) >= min(a * b, max(a, b) * min(classifier.PARTNERS, a))
    found = classifier._ranked(groups, lambda x: x[:, 0], [(True, True, 100), (True, False, 7), (False, True, 699)], 9)
    assert np.allclose(found, [np.sort(x[:, 0])[100], np.sort(x[:n_rare, 0])[7], x[n_rare:, 0].max()], atol=1e-8)
