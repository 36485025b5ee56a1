"""Every operator and every stage on odd tables: clashing columns, null and repeated ids, a very long text, no rows."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gridloom.llm import bpe, classifier, common, embeddings, lm, mixing, quality_rules, queries, secrets, simhash, substring, warc

CLASH = "size times lo hi wrap masked spans base_spans kept token_ids n_tokens fp id key node n words_key row_key taken target order shard i at first digest payload refers_to score held_out which side fine label v a.b".split()
PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of reused and null ids, repeated rows, null and blank texts, and one text of 5 MB in words and one piece of 1 MB."""
    rng = random.Random(1)
    plain = [" ".join(f"t{i}w{rng.randrange(10**6)}" for _ in range(80)) for i in range(6)]
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(650_000))
    texts = [None, "", " \n ", *plain, plain[0], plain[1] + " end", long, "x" * 1_000_000]
    ids = [1, None, 1, 2, 2, 3, 4, 5, None, 5, 6, 7, 8]
    rows = [(d, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit("own "), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in CLASH)).repartition(3)


OPERATORS = {
    "secrets": lambda d: secrets.find_secrets(d),
    "warc": lambda d: warc.write_pages(d, "doc_id", "lang", "text").lookup_all(d, "lang"),
    "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN),
    "lm": lambda d: lm.score(d, lm.crc_is(1, 5)),
    "substring": lambda d: substring.remove_repeats(d),
    "rules": lambda d: quality_rules.apply_rules(d, stats=("n_words",)),
    "classifier": lambda d: classifier.classify(d, classifier.train(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")), F.lit(True))),
    "mixing": lambda d: mixing.plan_mix(d),
    "simhash": lambda d: simhash.fingerprint_components(d),
    "embeddings": lambda d: embeddings.near_vectors(d.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0))), "doc_id", "vector", "lang"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(odd, name):
    out = OPERATORS[name](odd)
    assert out.count() == odd.count()
    kept = [c for c in CLASH if c in out.columns and c in odd.columns and dict(out.dtypes)[c] == "string"]
    if name in ("secrets", "bpe", "rules", "classifier"):  # those that keep columns
        assert len(kept) >= len(CLASH) - 4
        assert {r[0] for r in out.select(F.col(f"`{kept[0]}`")).collect()} == {r[0] for r in odd.select(F.col(f"`{kept[0]}`")).collect()}
    none = OPERATORS[name](odd.where("false"))
    assert none.count() == 0 and none.schema.names == out.schema.names


@pytest.mark.parametrize("stage", range(4))
def test_stage(spark, odd, stage):
    name, f = pipeline.STAGES[stage]
    out = f(spark, odd, "")
    assert out.schema.names == odd.schema.names
    own = {c: {r[0] for r in odd.select(F.col(f"`{c}`")).collect()} for c in ("size", "a.b")}
    rows = out.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(CLASH))).collect()
    assert rows and all(set(r[2:]) == {f"own {r.doc_id or 0}"} for r in rows)
    if stage == 1:
        texts = [r.text for r in odd.where("doc_id is not null").collect()]
        kept = [r.text for r in rows if r.doc_id is not None]
        assert len(kept) == len(set(kept)) and {t for t in texts if t and "t0w" not in t and "t1w" not in t and "x" != t[0]} - {t for t in kept} == set()
    if stage == 2:
        assert len(rows) == odd.count()
    assert f(spark, odd.where("false"), "").count() == 0 and own


def test_encode_stage_on_clashing_columns(spark, odd):
    out = pipeline.encode(spark, odd, "")
    assert out.count() == odd.count() and dict(out.dtypes)["token_ids"] == "binary" and dict(out.dtypes)["n_tokens"] == "bigint"
    assert {r["size"] for r in out.select("size").collect()} == {r["size"] for r in odd.select("size").collect()}


def test_temporary_tables_go(spark):
    with common.temporary(spark):
        inner = common.written(spark.range(3), "inner")
        outer = common.written(inner, "outer", outer=True)
    assert outer.count() == 3
    store, path = warc.opened(inner.inputFiles()[0].rsplit("/", 1)[0]) if inner.inputFiles() else (None, "")
    assert store is None or store.get_file_info(path).type.name == "NotFound"
