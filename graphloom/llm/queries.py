"""The registered queries of the training-data operators.

Each takes (spark, sf_dir), applies its operator to the whole table with
production parameters and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, warc
from .common import documents, held_out, table
from .oracle import ORACLES

#: Target token shares of op10 and of the pipeline's last stage.
TARGET_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4, max_bits=4)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs, ~held_out())
    found = language_id.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def base32_of_hex(digits):
    """Upper-case base32 of 40 hex digits: five of them are four letters."""
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    full = F.col("record_type") == "response"
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+)>$", 1).cast("bigint")
    return found.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, base32_of_hex(F.upper(F.sha1("payload")))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir), min_bytes=100).withColumnRenamed("id", "doc_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir), min_words=35).withColumnRenamed("id", "doc_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~held_out("id"))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    found = mixing.mix(docs, labelled, TARGET_WEIGHTS)
    return found.select(F.col("id").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("p").alias("posterior"), "domains", "rate", "n_copies", "shares")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_rules, op2_simhash_near_dedup, op3_language_id, op4_html_extraction, op5_warc,
        op6_suffix_array_dedup, op7_benchmark_decontamination, op8_substring_dedup, op9_quality_classifier, op10_source_mixing,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
