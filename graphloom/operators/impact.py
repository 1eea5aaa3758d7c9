"""Change impact: who refers to a symbol, how surely, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import module_of


def references(walk: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, confidence, depth, id, ordinal): one reference a place, the nearest first."""
    rows = walk.join(files.select(F.col("id").alias("src_file_id"), "path"), "src_file_id")
    place = W.partitionBy("path", "line").orderBy("depth", "id", "ordinal")
    return rows.withColumn("_rank", F.row_number().over(place)).where("_rank = 1").select("path", "line", "confidence", "depth", "id", "ordinal")


def buckets(refs: DataFrame) -> DataFrame:
    """(total, verified, likely, ambiguous) over distinct places."""
    c = F.col("confidence")
    return refs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c == "exact").alias("verified"),
        F.count_if(c.isin("heuristic", "resolved")).alias("likely"),
        F.count_if(~c.isin("exact", "heuristic", "resolved")).alias("ambiguous"),
    )


def by_module(refs: DataFrame) -> DataFrame:
    """(module, count, first): ``first`` is the place of the module's first reference, which orders modules of one count."""
    return refs.groupBy(module_of("path").alias("module")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("depth", "path", "line", "id", "ordinal")).alias("first"))
