"""Churn, co-change and hotspots from a commit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import four_digits, is_bug_fix

LARGE_COMMIT = 50
MIN_SUPPORT = 3


def in_window(commits: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Commits of the trailing window; none for a window of zero days."""
    if days <= 0:
        return commits.where(F.lit(False))
    end = now if now is not None else F.current_timestamp()
    return commits.where(F.col("committed_at") >= end - F.make_dt_interval(F.lit(days)))


def churn(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(file_id, commits, authors, bug_fixes, last_commit_at) over the commits given.

    The last commit is the first in the log's order where ``log_ordinal`` tells
    it (dates of a log need not fall, and carry offsets), else the latest.
    """
    last = F.min_by("committed_at", "log_ordinal") if "log_ordinal" in commits.columns else F.max_by("committed_at", F.struct("committed_at", "commit_id"))
    rows = commit_files.join(commits.withColumn("bug_fix", is_bug_fix("subject")), "commit_id")
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("commits"),
        F.countDistinct("author").alias("authors"),
        F.count_if("bug_fix").alias("bug_fixes"),
        last.alias("last_commit_at"),
    )


def co_changes(commits: DataFrame, commit_files: DataFrame, *, large: int = LARGE_COMMIT, support: int = 1) -> DataFrame:
    """(a, b, commits): file pairs of commits with at most ``large`` files, a < b."""
    rows = commit_files.join(commits.select("commit_id"), "commit_id", "left_semi")
    small = rows.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= large) & (F.col("n") > 1)).select("commit_id")
    rows = rows.join(small, "commit_id", "left_semi")
    a, b = rows.toDF("commit_id", "a"), rows.toDF("commit_id", "b")
    return a.join(b, "commit_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= support)


def commit_totals(commits: DataFrame, commit_files: DataFrame, large: int = LARGE_COMMIT) -> DataFrame:
    """(total_commits, skipped_large_commits)."""
    sizes = commit_files.join(commits.select("commit_id"), "commit_id", "left_semi").groupBy("commit_id").count()
    return commits.join(sizes, "commit_id", "left").agg(F.count(F.lit(1)).alias("total_commits"), F.count_if(F.col("count") > large).alias("skipped_large_commits"))


def hidden_coupling(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs without a dependency either way, directly or over one file between."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    left = pairs.join(both, ["a", "b"], "left_anti")
    # Two hops only ever start at a candidate's end, so the walk begins there.
    out_of = lambda end: left.select("a", "b").join(links.toDF("src", "mid"), F.col(end) == F.col("src")).select("a", "b", "mid")
    forward = out_of("a").join(links.toDF("mid", "b"), ["mid", "b"], "left_semi").select("a", "b")
    backward = out_of("b").join(links.toDF("mid", "a"), ["mid", "a"], "left_semi").select("a", "b")
    return left.join(forward.unionByName(backward).distinct(), ["a", "b"], "left_anti")


def hotspots(files: DataFrame, symbols: DataFrame, links: DataFrame, cyclic: DataFrame, history: DataFrame | None) -> DataFrame:
    """Every file's signals and score, churn times complexity.

    ``links`` includes self-imports: they count for the fan-in and not for
    the fan-out.  ``cyclic`` has the column file_id.  Without history the
    complexity alone ranks.
    """
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    fan_in = links.groupBy(F.col("dst").alias("file_id")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = links.where("src <> dst").groupBy(F.col("src").alias("file_id")).agg(F.count(F.lit(1)).alias("fan_out"))
    out = files.select(F.col("id").alias("file_id"), "path", "loc")
    for more in (counts, fan_in, fan_out, cyclic.withColumn("in_cycle", F.lit(1)), *([history] if history is not None else [])):
        out = out.join(more, "file_id", "left")
    if history is None:
        out = out.withColumn("commits", F.lit(0)).withColumn("bug_fixes", F.lit(0))
    out = out.na.fill(0, ["symbols", "fan_in", "fan_out", "in_cycle", "commits", "bug_fixes"])
    fan = F.col("fan_in") + F.col("fan_out")
    top = out.agg(*(F.greatest(F.lit(1), F.coalesce(F.max(c), F.lit(1))).cast("double").alias(n) for c, n in ((F.col("loc"), "max_loc"), (fan, "max_fan"), (F.col("commits"), "max_commits"), (F.col("bug_fixes"), "max_fixes"))))
    out = out.crossJoin(F.broadcast(top))  # one row
    complexity = F.lit(0.4) * F.col("loc") / F.col("max_loc") + F.lit(0.4) * fan / F.col("max_fan") + F.lit(0.2) * F.col("in_cycle")
    change = F.lit(1.0) if history is None else F.lit(0.6) * F.col("commits") / F.col("max_commits") + F.lit(0.4) * F.col("bug_fixes") / F.col("max_fixes")
    return out.withColumn("score", four_digits(complexity * change)).drop("max_loc", "max_fan", "max_commits", "max_fixes")
