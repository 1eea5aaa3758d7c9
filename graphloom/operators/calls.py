"""Call resolution: from call sites to edges with an explicit confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import module_of

PACKAGE_LANGS = ("go", "java")  # languages whose files see their directory without an import


def same_package_pairs(files: DataFrame) -> DataFrame:
    """(src, dst): files of one package language in one directory, without itself."""
    f = files.where(F.col("lang").isin(*PACKAGE_LANGS)).select("id", "lang", module_of("path").alias("module"))
    other = f.select(F.col("id").alias("dst"), "lang", "module")
    return f.withColumnRenamed("id", "src").join(other, ["lang", "module"]).where("src <> dst").select("src", "dst")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, target): resolved imports; a Go import takes in its package's directory."""
    direct = imports.where(F.col("resolved_file_id").isNotNull()).select("file_id", F.col("resolved_file_id").alias("target")).distinct()
    go = files.where(F.col("lang") == "go").select("id", module_of("path").alias("module"))
    packages = direct.join(go.select(F.col("id").alias("file_id")), "file_id", "left_semi").join(go.withColumnRenamed("id", "target"), "target").select("file_id", "module").distinct()
    wide = packages.join(go.withColumnRenamed("id", "target"), "module").select("file_id", "target")
    return direct.unionByName(wide).distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of every call site; each call gives at least one.

    A local symbol of the called name shadows everything else.  Otherwise the
    candidates are the exported symbols of imported files and, in package
    languages, all symbols of the directory's other files.  One candidate is
    ``heuristic``, several ``ambiguous`` (an edge each), none ``unresolved``.
    ``ordinal`` numbers a call's edges by (file, symbol).
    """
    names = symbols.select(F.col("id").alias("dst_symbol_id"), F.col("file_id").alias("dst_file_id"), "name", "exported")
    site = calls.select("id", "file_id", "name")
    local = site.join(names.withColumnRenamed("dst_file_id", "file_id"), ["file_id", "name"]).select("id", F.col("file_id").alias("dst_file_id"), "dst_symbol_id")
    foreign = site.join(local.select("id"), "id", "left_anti")
    exports = names.where("exported").select("dst_symbol_id", F.col("dst_file_id").alias("target"), "name")
    # Sites meet targets before exports, so that only exports of a called name are met.
    by_import = foreign.join(import_targets(imports, files), "file_id").join(exports, ["target", "name"]).select("id", F.col("target").alias("dst_file_id"), "dst_symbol_id")
    package = files.where(F.col("lang").isin(*PACKAGE_LANGS)).select("id", "lang", module_of("path").alias("module"))
    inside = names.join(package.withColumnRenamed("id", "dst_file_id"), "dst_file_id").select("dst_symbol_id", "dst_file_id", "name", "lang", "module")
    near = foreign.join(package.withColumnRenamed("id", "file_id"), "file_id").join(inside, ["lang", "module", "name"]).where("dst_file_id <> file_id")
    by_package = near.select("id", "dst_file_id", "dst_symbol_id")
    found = local.unionByName(by_import).unionByName(by_package).distinct()
    each = W.partitionBy("id")
    found = found.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("ordinal", F.row_number().over(each.orderBy("dst_file_id", "dst_symbol_id")))
    last = symbols.groupBy("file_id", F.col("name").alias("enclosing")).agg(F.max_by("id", F.struct("start_line", "id")).alias("src_symbol_id"))  # the last of a name counts
    edges = calls.join(found, "id", "left").join(last, ["file_id", "enclosing"], "left")
    tier = F.when(F.col("n").isNull(), F.lit("unresolved")).when(F.col("n") == 1, F.lit("heuristic")).otherwise(F.lit("ambiguous"))
    return edges.select(
        "id",
        F.coalesce("ordinal", F.lit(1)).cast("bigint").alias("ordinal"),
        F.col("file_id").alias("src_file_id"),
        "src_symbol_id",
        "dst_file_id",
        "dst_symbol_id",
        F.col("name").alias("dst_name"),
        "kind",
        tier.alias("confidence"),
        "line",
    )


def edge_details(edges: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the paths and names of both ends; outer where an end is unknown."""
    f = files.select("id", "path")
    s = symbols.select("id", "name")
    out = edges.join(f.toDF("src_file_id", "src_path"), "src_file_id")
    out = out.join(s.toDF("src_symbol_id", "src_name"), "src_symbol_id", "left")
    out = out.join(f.toDF("dst_file_id", "dst_path"), "dst_file_id", "left")
    return out.join(s.toDF("dst_symbol_id", "dst_symbol_name"), "dst_symbol_id", "left")
