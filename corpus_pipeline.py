"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's rows and reads them again.

Stages and odd rows: null texts have no words and leave at the first stage; documents with a
null id pass the near-duplicate stage; rows of one id stay there if their texts are not near-duplicates, and of
repeated rows one stays. Extra columns of any name pass all stages unchanged; only the last replaces those that have the
name of a column it adds (token_ids, n_tokens, decoded_sha256). Empty tables give empty tables.
``run`` deletes what stages leave in the shared folder, but for the last one's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, quality_rules, secrets, simhash
from gridloom.llm.common import aside, drop, row_key, scratch, table, temporary
from gridloom.llm.common import written as written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: A mixed text is cut and a secret is masked, so no SQL speaks for the whole.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    own, back = aside(docs, "text")
    return back(quality_rules.apply_rules(own).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id, and then row key, of each group; five-word shingles, similarity of 0.8 or more."""
    own, back = aside(docs, "doc_id", "text")
    groups = simhash.near_duplicates(own, size=5, min_similarity=0.8)
    first = groups.where("first").select("doc_id", F.col("row_key").alias("\u0001key")).distinct()
    keyed = own.withColumn("\u0001key", row_key(own.columns))
    kept = keyed.join(first, ["doc_id", "\u0001key"], "left_semi").dropDuplicates(["doc_id", "\u0001key"])
    return back(kept).unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    own, back = aside(docs, "text", "n_chars")
    found = secrets.find_secrets(own)
    some = F.size("spans") > 0
    out = found.withColumn("masked", secrets.redacted(F.col("text"), F.col("spans")))
    out = out.withColumn("n_chars", F.when(some, F.char_length("masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return back(out.withColumn("text", F.col("masked")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one at the border of a chosen stretch gives its part."""
    own, back = aside(docs, "doc_id", "source", "text", "n_chars")
    out = mixing.mixed_documents(own, mixing.plan_mix(own))
    return back(out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), and the digest of the bytes they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = bpe.encode_documents(docs, path, pattern).drop("text")
    return bpe.decode_documents(ids, path, pattern).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
