"""Incremental maintenance: what changed, whom it touches, what to rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory


def change_set(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, status): full outer comparison of content hashes, (path, content_hash) each.

    A file that cannot be hashed now counts as changed.
    """
    both = now.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("there")).join(before.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("known")), "path", "full_outer")
    status = F.when(F.col("there").isNull(), F.lit("deleted")).when(F.col("known").isNotNull() & (F.col("new") == F.col("old")), F.lit("unchanged")).otherwise(F.lit("changed"))
    return both.select("path", status.alias("status"))


def changed_resolutions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path) of importers whose resolution differs now, in path or confidence.

    Both have (id, path, resolved, confidence).
    """
    new = fresh.select("id", F.col("resolved").alias("r2"), F.col("confidence").alias("c2"))
    differs = ~(F.col("resolved").eqNullSafe(F.col("r2")) & F.col("confidence").eqNullSafe(F.col("c2")))
    return stored.join(new, "id").where(differs).select("path").distinct()


def dilation(changes: DataFrame, imports: DataFrame, files: DataFrame, package_langs: tuple[str, ...] = ("go", "java")) -> DataFrame:
    """(path) of every surviving file to resolve again, the changed ones included.

    Importers of a changed or deleted file; files of a package language in the
    directory of one; and Go files that import a package with one in it.
    ``imports`` has (path, resolved) and ``files`` (path, lang) of old and new
    files alike.
    """
    touched = changes.where("status <> 'unchanged'").select("path")
    importers = imports.join(touched.select(F.col("path").alias("resolved")), "resolved", "left_semi").select("path")
    package = files.where(F.col("lang").isin(*package_langs)).select("path", "lang", directory("path").alias("dir"))
    dirs = package.join(touched, "path", "left_semi").select("lang", "dir").distinct()
    siblings = package.join(dirs, ["lang", "dir"], "left_semi").select("path")
    go_dirs = dirs.where("lang = 'go'").select("dir")
    go_importers = imports.where(F.endswith("path", F.lit(".go"))).select("path", directory("resolved").alias("dir")).join(go_dirs, "dir", "left_semi").select("path")
    every = touched.unionByName(importers).unionByName(siblings).unionByName(go_importers).distinct()
    return every.join(changes.where("status = 'deleted'").select("path"), "path", "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Old rows whose key is not in ``gone``, and all new ones."""
    return old.join(gone.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def unlink_targets(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges into deleted files keep their row and confidence and lose their target.

    ``edges`` has (dst_file_id, dst_symbol_id, ...), ``deleted`` (id).
    """
    gone = deleted.select(F.col("id").alias("dst_file_id"), F.lit(True).alias("_gone")).distinct()
    out = edges.join(gone, "dst_file_id", "left")
    keep = F.col("_gone").isNull()
    return out.withColumn("dst_file_id", F.when(keep, F.col("dst_file_id"))).withColumn("dst_symbol_id", F.when(keep, F.col("dst_symbol_id"))).select(*edges.columns)
