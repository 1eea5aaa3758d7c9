"""Queries over resolvers, maintenance, sources and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.languages import language_of, skip_reason
from .functions.paths import basename, directory, extension, normalize, shared_segments
from .functions.scores import lines_of_code
from .operators import incremental, resolve, search
from .plans.projection import project
from .streaming import churn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importing file and named file: six ids apart, so that both have one language."""
    f = project(spark, sf_dir).files.select("id", "path", "lang")
    return f.join(f.select((F.col("id") - 6).alias("id"), F.col("path").alias("target")), "id")


def _resolved(spark: SparkSession, sf_dir: str, lang: str, specifier, resolver) -> DataFrame:
    rows = _neighbours(spark, sf_dir).where(F.col("lang") == lang).select("id", "path", specifier.alias("specifier"))
    known = project(spark, sf_dir).files.select("path")
    return rows.join(resolver(rows, known), "id").select("id", "specifier", "resolved", "confidence")


@query
def resolve_javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``./name`` beside the importer, ``../x/name.js`` for its TypeScript source, packages stay unresolved."""
    stem = F.regexp_replace(basename("target"), r"\.ts$", "")
    up = F.concat(F.lit("../"), F.substring_index(directory("target"), "/", -1), F.lit("/"), stem, F.lit(".js"))
    spec = F.when(F.col("id") % 4 == 0, F.lit("lodash")).when(F.col("id") % 4 == 2, up).otherwise(F.concat(F.lit("./"), stem))
    spec = F.when(F.col("id") % 12 == 0, F.concat(F.lit("./"), stem)).otherwise(spec)
    return _resolved(spark, sf_dir, "typescript", spec, resolve.javascript)


@query
def resolve_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.translate(F.regexp_replace("target", r"\.py$", ""), "/", ".")
    spec = F.when(F.col("id") % 5 == 0, F.lit("os.path")).when(F.col("id") % 2 == 0, dotted).otherwise(F.concat(dotted, F.lit(".Item")))
    return _resolved(spark, sf_dir, "python", spec, resolve.python)


@query
def resolve_java(spark: SparkSession, sf_dir: str) -> DataFrame:
    fqn = F.translate(F.regexp_replace(F.regexp_replace("target", r"^[^/]*/", ""), r"\.java$", ""), "/", ".")
    spec = F.when(F.col("id") % 5 == 0, F.concat(fqn, F.lit(".*"))).otherwise(fqn)
    return _resolved(spark, sf_dir, "java", spec, resolve.java)


@query
def resolve_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(F.col("id") % 5 == 0, F.lit("fmt")).otherwise(F.concat(F.lit("example.com/m/"), directory("target")))
    return _resolved(spark, sf_dir, "go", spec, lambda rows, known: resolve.go(rows, known, "example.com/m"))


@query
def resolve_rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``super`` paths to a module, everything in it and an item of it; ``crate`` without a root and other crates stay unresolved."""
    stem = F.regexp_replace(basename("target"), r"\.rs$", "")
    near = F.concat(F.lit("super::"), stem, F.when(F.col("id") % 5 == 3, F.lit("::*")).when(F.col("id") % 5 == 4, F.lit("::Item")).otherwise(F.lit("")))
    spec = F.when(F.col("id") % 5 == 0, F.lit("std::fmt::Debug")).when(F.col("id") % 5 == 1, F.lit("crate::a::b")).otherwise(near)
    return _resolved(spark, sf_dir, "rust", spec, resolve.rust)


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files now, files before, all files): an edit of every 13th, additions and deletions."""
    files = project(spark, sf_dir).files
    digest = lambda x: F.sha2(F.concat("path", x), 256)
    edited = F.when(F.col("id") % 13 == 0, F.lit("!")).otherwise(F.lit(""))
    now = files.where("id % 17 <> 0").select("path", F.when(F.col("id") % 19 != 0, digest(edited)).alias("content_hash"))
    before = files.where("id % 11 <> 0").select("path", digest(F.lit("")).alias("content_hash"))
    return now, before, files


@query
def changeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before, _ = _states(spark, sf_dir)
    return incremental.change_set(now, before)


@query
def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before, files = _states(spark, sf_dir)
    names = files.select("id", "path")
    imports = project(spark, sf_dir).imports.join(names.toDF("file_id", "path"), "file_id").join(names.toDF("resolved_file_id", "resolved"), "resolved_file_id").select("path", "resolved")
    return incremental.dilation(incremental.change_set(now, before), imports, files.select("path", "lang"))


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = F.when(F.col("doc_id") % 9 == 0, F.lit("vendor/")).otherwise(F.lit("lib/"))
    end = F.when(F.col("doc_id") % 7 == 0, F.lit(".min.js")).when(F.col("doc_id") % 3 == 0, F.lit(".py")).otherwise(F.lit(".txt"))
    return d.select(F.concat(top, "source", F.lit("/f"), F.col("doc_id").cast("string"), end).alias("path"), "text")


@query
def skip_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _as_files(spark, sf_dir).withColumn("content", F.col("text").cast("binary"))
    reason = skip_reason("path", F.octet_length("content") * 50, "content")
    return rows.select(F.coalesce(reason, F.lit("indexed")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, lines of code and content hash, as extraction records them."""
    rows = _as_files(spark, sf_dir)
    return rows.select("path", extension("path").alias("extension"), language_of("path").alias("lang"), lines_of_code("text").cast("bigint").alias("loc"), F.sha2("text", 256).alias("content_hash"))


@query
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = project(spark, sf_dir).files
    return f.select("path", normalize(F.concat("path", F.lit("/../.././x//"), basename("path"))).alias("folded"), shared_segments("path", F.lit("pkg1/m1/z")).cast("bigint").alias("shared"))


@query
def manifest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-tolerant JSON reading, as for manifests, over the events' properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query
def truncation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped list with its true total."""
    g = project(spark, sf_dir)
    return search.with_total(g.symbols.where("exported").select("id", "name")).orderBy("id").limit(25)


@query
def windowed_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return churn.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def streaming_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream, the open ones included."""
    e = spark.readStream.schema(churn.EVENTS.replace("ts timestamp", "ts timestamp_ntz")).parquet(f"{sf_dir}/events.parque[t]")
    found = churn.windows_of(churn.drain(churn.user_counts(e.withColumn("ts", F.col("ts").cast("timestamp")))))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
