"""Column functions over slash-separated repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def directory(path) -> Column:
    """Parent directory; the empty string at the root."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def module_of(path) -> Column:
    """The module that owns a file: its directory, or ``.`` at the root."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def top_segment(path) -> Column:
    """The first path segment; ``.`` for files at the root."""
    p = _c(path)
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)).otherwise(F.lit("."))


def extension(path) -> Column:
    """From the last dot of the base name on; none where that dot comes first."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalize(path) -> Column:
    """Folds ``.`` and ``..`` segments; null where the path climbs above the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc, seg):
        kept = acc["kept"]
        up = F.struct(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))).alias("kept"), (acc["ok"] & (F.size(kept) > 0)).alias("ok"))
        down = F.struct(F.array_append(kept, seg).alias("kept"), acc["ok"].alias("ok"))
        return F.when((seg == "") | (seg == "."), acc).when(seg == "..", up).otherwise(down)

    folded = F.aggregate(F.split(_c(path), "/"), start, step)
    return F.when(folded["ok"], F.array_join(folded["kept"], "/"))


def ancestors(path) -> Column:
    """Every directory above a path, nearest first, down to the root's empty string."""
    parts = F.split(_c(path), "/")
    depths = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def shared_segments(a, b) -> Column:
    """How many leading segments two paths share."""
    x, y = F.split(_c(a), "/"), F.split(_c(b), "/")
    most = F.least(F.size(x), F.size(y))
    differs = F.filter(F.sequence(F.lit(0), most - 1), lambda i: F.get(x, i) != F.get(y, i))
    return F.coalesce(F.array_min(differs), most)
