"""A training corpus in five stages: rules, near copies, repeats, leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns what stays; ``run`` writes
every stage's result as Parquet in the shared folder and gives it to the next.
All but the last return the columns of ``documents``; the last adds the
fitted ``rate`` and the ``n_copies`` that round it.

A row is known by its id and a hash of its text, so rows that share an id but
not a text are documents of their own, and rows without an id take part like
any other.  Rows equal in both are copies, of which near-dedup keeps one.  A
null text counts as empty; of equal ids the hash of the text decides which
copy stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from graphloom.llm import decontaminate, mixing, quality_rules, substring_dedup
from graphloom.llm import near_copies as near_dup
from graphloom.llm.common import documents, materialize, table
from graphloom.llm.queries import TARGET_WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which tells its rows apart, those without an id last."""
    kind = docs.schema["doc_id"].dataType
    none = F.lit(0 if isinstance(kind, NumericType) else "").cast(kind)
    return docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("noid"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("hash")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies stays.

    Near copies share four fifths of their five-word shingles or more; every
    such pair is found, and none below that links.
    """
    rows = identified(docs)
    found = near_dup.near_copies(rows.select("_row", "text"), width=5, similarity=(4, 5), id_col="_row")
    firsts = found.where("id = component").select(F.col("id").alias("_row"))
    return rows.join(firsts, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again are cut out."""
    return substring_dedup.drop_repeats(docs, min_words=35).withColumn("n_chars", F.length("text").cast("bigint"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    cleaned = decontaminate.scan_documents(docs, table(spark, sf_dir, "benchmark"), n=10, action="clean")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate at which the mixture takes it."""
    rows = identified(docs)
    found = mixing.mix(rows.select("_row", "text"), rows.select("_row", F.col("lang").alias("domain")), TARGET_WEIGHTS, id_col="_row")
    rates = found.select(F.col("id").alias("_row"), F.col("rate").alias("_rate"), F.col("n_copies").alias("_copies")).dropDuplicates(["_row"])
    kept = [c for c in docs.columns if c not in ("rate", "n_copies")]
    return rows.join(rates, "_row", "left").select(*kept, F.col("_rate").alias("rate"), F.col("_copies").alias("n_copies"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_copies),
    ("substring dedup", repeats),
    ("benchmark decontamination", leaks),
    ("source mixing", mixture),
]

#: Shingle sets, the selection of cutoffs and the fit are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
