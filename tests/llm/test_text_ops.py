"""op3, op6 and op9 against brute force, and the edge cases of their operators."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, components, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t\n\v\f\r]+")
ODD = [None, "", " \n\t ", "a", "x" * 5000, "ab " * 3000, "Ünïcode ça 日本語 😀   x", "same", "same", "don't  stop\r\n\r\n 123 !!"]


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def coder():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        raw = f.read()
    ours = bpe.Tokenizer(raw, public_tokenizers.PATTERN)
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.rank, special_tokens={})


def test_bpe_matches_merging(coder):
    ours, theirs = coder
    rng = random.Random(3)
    kinds = ["ab", "the aein", "0123 ", "éèà çñ aei", "\n\t \r\x0b\x1c\x85\xa0 a'", "日本語の文 漢字", "'s't'LL're x", "!?#$%&*-= ", "привет мир", "😀😁 é"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        got = ours.encode(t)
        want = theirs.encode_ordinary(t)
        assert got == b"".join(i.to_bytes(4, "little") for i in want), t
        assert ours.decode(got) == t.encode()


def test_bpe_long_pieces(coder):
    """One piece of many letters: the ids of merging, in time that grows with the letters alone."""
    ours, theirs = coder
    rng = random.Random(8)
    letters = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(1_000_000))
    for t in (letters[:20_000], "a" * 30_001, "ab" * 10_000, "é" * 9_999):
        assert ours.encode(t) == b"".join(i.to_bytes(4, "little") for i in theirs.encode_ordinary(t))
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        assert ours.decode(ours.encode(letters[:n])) == letters[:n].encode()
        took.append(time.process_time() - began)
    assert took[1] <= 20 * took[0]


def test_op3(spark, documents, coder):
    _, theirs = coder
    want = {}
    for d, t in documents:
        ids = theirs.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_byte_bpe(spark, SF).collect()}
    assert got == want


def test_bpe_edges(docs_of):
    path, pattern = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
    docs = docs_of(ODD).withColumn("n_tokens", F.lit("clash"))
    rows = bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in rows] == [t or "" for t in ODD]
    assert rows[0].n_tokens == 0 and rows[3].n_tokens == 1
    assert bpe.encode_documents(docs.where("false"), path, pattern).count() == 0


def brute_quality(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_op6(spark, documents):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, t in documents:
        want = brute_quality(t or "")
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_verdict_is_free_of_order(docs_of):
    rules = quality_rules.DEFAULT_RULES
    texts = [t or "" for t in ODD] + ["word " * 100, " ".join(f"w{i}" for i in range(80))]
    assert [m.rejected for m in quality_rules.measure(rules, [b""])][0] == 1
    for t in texts:
        f = quality_rules.Features(t.encode())
        assert (quality_rules.first_failure(rules, f) is None) == (quality_rules.first_failure(rules[::-1], f) is None)
    order = quality_rules.cascade([quality_rules.Measured(r, s, n) for r, s, n in zip(rules, (1, 1, 1, 1, 1, 1, 0.1), (0, 5, 1, 0, 0, 0, 2), strict=True)])
    assert [r.name for r in order[:3]] == ["one_word", "repeated_windows", "symbols"]
    docs = docs_of(ODD).withColumn("kept", F.lit("clash"))
    assert [r.kept for r in quality_rules.apply_rules(docs).orderBy("doc_id").collect()] == [False] * len(ODD)
    assert quality_rules.apply_rules(docs.where("false"), stats=("n_words",)).count() == 0


def brute_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """``fps``: id and fingerprint of rows."""
    up = {d: d for d, _ in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d, _ in fps}


def test_op9(spark, documents):
    fps = [(d, brute_fingerprint(t or "")) for d, t in documents]
    component = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {d: (f"{x:016x}", component[d]) for d, x in fps}


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_links_connect_everything_within_three_bits(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        x = b
        for _ in range(60):  # chains and clusters, some of them longer than a hot list
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x = b
    rows = [(i, 1, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "id long, n long, fp binary")
    found = simhash.links(df, simhash.exact_index(3), hot).collect()
    by_id = dict(enumerate(sorted(fps)))
    assert all((by_id[r.a] ^ by_id[r.b]).bit_count() <= 3 for r in found)
    pairs = spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")
    got = {r.node: r.component for r in simhash.connected_components(pairs).collect()}
    want = brute_components(list(by_id.items()))
    assert {i: got.get(i, i) for i in by_id} == want


def test_simhash_edges(docs_of, spark):
    docs = docs_of(ODD)
    rows = simhash.fingerprint_components(docs).orderBy("doc_id").collect()
    assert [r.fingerprint == "0" * 16 for r in rows][:3] == [True] * 3
    assert [r.component_id for r in rows][:3] == [0, 0, 0] and rows[8].component_id == 7
    assert simhash.fingerprint_components(docs.where("false")).count() == 0
    null = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert simhash.fingerprint_components(null).count() == len(ODD)


def test_near_duplicates(docs_of):
    rng = random.Random(5)
    texts = []
    for g in range(30):
        w = [f"g{g}w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(w))
        for edits in (1, 3, 5):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(300)] = "changed"
            texts.append(" ".join(v))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(texts)).collect()}
    assert all(got[i] // 4 == i // 4 for i in got)  # nothing unlike is linked
    assert sum(got[i] == i // 4 * 4 for i in got) >= 0.97 * len(texts)


def test_long_lists_lose_no_link(docs_of):
    rng = random.Random(9)
    texts = []
    for g in range(4):
        w = [f"g{g}w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(40):
            v = list(w)
            for _ in range(rng.randrange(6)):
                v[rng.randrange(200)] = f"other{rng.randrange(9)}"
            texts.append(" ".join(v))
    docs = docs_of(texts)
    whole = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    for hot in (7, 16):  # lists of about 40 members, in blocks
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, hot=hot).collect()} == whole
    assert len(set(whole.values())) < len(texts) / 2


def test_components_with_hubs(spark):
    rng = random.Random(3)
    pairs = [(x, 5) for x in range(100, 1400)] + [(x, 9000) for x in range(2000, 2700)] + [(9000, 1399), (0, 2100)]
    pairs += [(20_000 + i, 20_001 + i) for i in range(40)] + [(7, 7), (None, 8), (3, None)]
    nodes = sorted({x for p in pairs for x in p if x is not None})
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            p, q = sorted((root(a), root(b)))
            up[q] = p
    rng.shuffle(pairs)
    found = simhash.connected_components(spark.createDataFrame(pairs * 2, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    assert {x: got.get(x, x) for x in nodes} == {x: root(x) for x in nodes}
    assert len(found) == len(got)


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(x, x + 1) for x in range(0, 600, 2)] + [(rng.randrange(500), rng.randrange(500)) for _ in range(150)] + [(4000 - i, 4001 - i) for i in range(300)]
    pairs += [(x, 9000) for x in range(5000, 5400)] + [(-(2**62), 2**62), (3, 3), (None, 4), (4, None)]
    df = spark.createDataFrame(pairs, "a long, b long")
    rounds = []
    monkeypatch.setattr(components, "_large_star", lambda *a, f=components._large_star: rounds.append(1) or f(*a))
    few = sorted(components.connected_components(df).collect())
    assert not rounds  # the driver plans no round for so few links
    assert sorted(components.connected_components(df, few=100).collect()) == few and rounds
    up = {x: x for p in pairs if None not in p for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in (p for p in pairs if None not in p):
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    assert few == sorted((x, c) for x, c in up.items() if x != c)
    assert components.connected_components(df.where("a = b")).count() == 0


def test_near_duplicates_at_the_threshold(docs_of):
    rng = random.Random(3)
    pairs, texts = [], []
    for near in (0.75, 0.78, 0.80, 0.82, 0.85) * 40:
        words = [f"p{len(pairs)}w{i}" for i in range(404)]
        swapped = round((1 - near) / (1 + near) * 400 - (0.5 if near < 0.8 else 1) + 0.5)
        tail = [f"p{len(pairs)}x{i}" for i in range(swapped)]
        rng.shuffle(words)
        other = words[: 404 - swapped] + tail  # only the shingles of the end differ
        texts += [" ".join(words), " ".join(other)]
        a, b = ({tuple(t[i : i + 5]) for i in range(400)} for t in (words, other))
        pairs.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(texts)).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]
    assert not any(on for on, near in zip(linked, pairs) if near < 0.8)
    for low, high, least in ((0.8, 0.815, 0.9), (0.815, 0.84, 0.9), (0.84, 1, 0.95)):
        some = [on for on, near in zip(linked, pairs) if low <= near < high]
        assert len(some) >= 20 and sum(some) >= least * len(some)
