"""The queries of this folder's operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, classifier, embeddings, lm, mixing, quality_rules, secrets, simhash, substring, warc
from gridloom.llm.common import table, written
from gridloom.llm.oracles import ORACLES as ORACLES

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.written_spans(F.col("base_spans")), 256).alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.write_pages(pages).lookup_all(pages)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_documents(docs, path, pattern).select("doc_id", "n_tokens", "token_ids")
    both = bpe.decode_documents(ids, path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), lm.crc_is(1, 5))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules.apply_rules(docs, stats=stats)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *stats, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(classifier.with_features(table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 4 == 2
    model = classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out("id"), text="features")
    return classifier.classify(docs, model, text="features").select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc_index, op3_byte_bpe, op4_lm_score, op5_substring_dedup, op6_quality_rules, op7_quality_classifier, op8_mixing, op9_simhash, op10_embeddings)}
