"""Repository-wide totals and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, top_segment
from ..functions.scores import four_digits
from ..schemas import CONFIDENCES

#: Base names that start a program, by language (fixed values).
ENTRY_BASENAMES = (
    "index.ts", "main.ts", "server.ts", "app.ts", "cli.ts", "index.tsx", "index.js", "index.mjs", "main.js", "server.js", "app.js", "cli.js",
    "__main__.py", "main.go", "Main.java", "main.rs",
)


def totals(files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, total): one combinable count for each table."""
    named = (("files", files), ("symbols", symbols), ("imports", imports), ("edges", edges))
    out = None
    for name, df in named:
        one = df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("name"), "total")
        out = one if out is None else out.unionByName(one)
    errors = files.agg(F.coalesce(F.sum("error_count"), F.lit(0)).alias("total")).select(F.lit("parse_errors").alias("name"), "total")
    return out.unionByName(errors)


def languages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(lang, files, symbols); files of no known language are a group of their own."""
    per_file = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = files.join(per_file, files.id == per_file.file_id, "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def edge_confidence(edges: DataFrame) -> DataFrame:
    """(confidence, edges) for all tiers, zeros included."""
    tiers = edges.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    counts = edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("edges"))
    return tiers.join(F.broadcast(counts), "confidence", "left").na.fill(0, ["edges"])


def internal_fraction(edges: DataFrame) -> DataFrame:
    """(fraction): edges with a target in the repository over all edges; 0 without edges."""
    inside = F.count_if(F.col("confidence") != "unresolved")
    return edges.agg(F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(four_digits(inside / F.count(F.lit(1)))).alias("fraction"))


def top_modules(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, files, symbols) by first path segment."""
    per_file = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = files.join(per_file, files.id == per_file.file_id, "left")
    return rows.groupBy(top_segment("path").alias("module")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def is_entry_point(path, extra: tuple[str, ...] = (), names: tuple[str, ...] = ENTRY_BASENAMES) -> Column:
    """By base name, or by being named in the package manifest (``extra``)."""
    p = F.col(path) if isinstance(path, str) else path
    return basename(p).isin(*names) | (p.isin(*extra) if extra else F.lit(False))
