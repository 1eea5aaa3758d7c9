"""Symbol predicates, code search, and capped results with true totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

SNIPPET = 200


def symbol_filter(*, name: str | None = None, contains: str | None = None, kind: str | None = None, exported: bool | None = None, path_prefix: str | None = None, lang: str | None = None) -> Column:
    """Conjunction of the given conditions; omitted ones hold.

    ``contains`` and ``path_prefix`` ignore case and treat every character
    literally; ``name`` is exact.
    """
    out = F.lit(True)
    if name is not None:
        out &= F.col("name") == name
    if contains is not None:
        out &= F.contains(F.lower("name"), F.lit(contains.lower()))
    if kind is not None:
        out &= F.col("kind") == kind
    if exported is not None:
        out &= F.col("exported") == exported
    if path_prefix is not None:
        out &= F.startswith(F.lower("path"), F.lit(path_prefix.lower()))
    if lang is not None:
        out &= F.col("lang") == lang
    return out


def symbol_hits(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and language of their file."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "path", "lang"), "file_id")


def find_symbols(hits: DataFrame, limit: int, **conditions) -> DataFrame:
    """Matching symbols, shortest names first, with the true total."""
    found = with_total(hits.where(symbol_filter(**conditions)))
    return found.orderBy(F.length("name"), "name", "path", "id").limit(limit)


def with_total(df: DataFrame) -> DataFrame:
    """``total``: the number of rows before any limit, from one combinable aggregate."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def text_lines(texts: DataFrame, needle: str, *, path_prefix: str | None = None, lang: str | None = None) -> DataFrame:
    """(path, line, snippet) of lines that contain the needle, whatever the case.

    Whole texts are tested before any is split into lines.
    """
    low = needle.lower()
    rows = texts.where(F.contains(F.lower("text"), F.lit(low)))
    if path_prefix is not None:
        rows = rows.where(F.startswith("path", F.lit(path_prefix)))
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    lines = rows.select("path", F.posexplode(F.split("text", "\n")).alias("at", "content")).where(F.contains(F.lower("content"), F.lit(low)))
    trimmed = F.regexp_replace("content", r"^\s+|\s+$", "")
    return lines.select("path", (F.col("at") + 1).alias("line"), F.substring(trimmed, 1, SNIPPET).alias("snippet"))


def search_code(hits: DataFrame, texts: DataFrame, query: str, limit: int, *, kind: str | None = None, path: str | None = None, lang: str | None = None) -> DataFrame:
    """Exact symbols, then symbols that contain the query, then text lines.

    One hit a place: the first in that order wins.  Text is not searched when
    a symbol kind is asked for.
    """
    schema = "path string, line int, kind string, symbol_name string, snippet string, score int, total bigint"
    if not query:
        return hits.sparkSession.createDataFrame([], schema)
    found = hits.where(symbol_filter(contains=query, kind=kind, path_prefix=path, lang=lang))
    score = F.when(F.col("name") == query, F.lit(100)).otherwise(F.lit(60))
    snippet = F.substring(F.coalesce("signature", "name"), 1, SNIPPET)
    out = found.select("path", F.col("start_line").alias("line"), F.lit("symbol").alias("kind"), F.col("name").alias("symbol_name"), snippet.alias("snippet"), score.alias("score"), F.length("name").alias("_len"), F.col("id").alias("_id"))
    if kind is None:
        text = text_lines(texts, query, path_prefix=path, lang=lang)
        out = out.unionByName(text.select("path", "line", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("symbol_name"), "snippet", F.lit(20).alias("score"), F.lit(0).alias("_len"), F.lit(0).cast("bigint").alias("_id")))
    place = W.partitionBy("path", "line").orderBy(F.desc("score"), "_len", "symbol_name", "_id")
    first = out.withColumn("_rank", F.row_number().over(place)).where("_rank = 1").drop("_rank", "_len", "_id")
    return with_total(materialize(first, "hits")).orderBy(F.desc("score"), "path", "line").limit(limit)


def callers_and_callees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol with the number of edges that end and start at it."""
    callers = edges.where("dst_symbol_id is not null").groupBy(F.col("dst_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("caller_count"))
    callees = edges.where("src_symbol_id is not null").groupBy(F.col("src_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("callee_count"))
    return symbols.join(callers, "id", "left").join(callees, "id", "left").na.fill(0, ["caller_count", "callee_count"])
