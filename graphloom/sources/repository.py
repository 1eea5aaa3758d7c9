"""Repositories as tables: files, git history, and manifests.

Listing happens on the driver (one process has the checkout's metadata);
contents are read by executors, path by listed path, so that large checkouts
on shared storage spread over the cluster.  (A file source would leave out
names that begin with ``_`` or ``.``.)
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.languages import MAX_BYTES, VENDORED, skip_reason, vendored

FILES_PER_TASK, READ_BYTES = 500, 8 << 20
RECORD, UNIT = "\x1e", "\x1f"


def git(root: str, *args: str) -> str | None:
    """Trimmed output of a git command; None on any failure.  (A bare strip() would take the record separator too.)"""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError:
        return None
    return done.stdout.decode("utf-8", "replace").strip(" \t\r\n") if done.returncode == 0 else None


def is_git(root: str) -> bool:
    return git(root, "rev-parse", "--is-inside-work-tree") == "true"


def head_commit(root: str) -> str | None:
    return git(root, "rev-parse", "HEAD")


def is_clean(root: str) -> bool:
    return git(root, "status", "--porcelain") == ""


def index_dir(root: str, home: str) -> str:
    """Where a repository's index lives: named by a hash of its absolute path."""
    return f"{home}/{hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:16]}"


def gitignore_names(root: str) -> set[str]:
    """Literal names of the top-level ``.gitignore``; patterns are not interpreted."""
    try:
        lines = Path(root, ".gitignore").read_text().splitlines()
    except OSError:
        return set()
    names = (x.strip().strip("/") for x in lines)
    return {n for n in names if n and not n.startswith(("#", "!")) and not any(c in n for c in "*?[/")}


def list_candidates(root: str) -> list[str]:
    """Paths to classify: tracked and untracked files of a git checkout, else a walk.

    The walk prunes vendored and ignored directories and leaves one marker
    entry for each vendored one, so that skip counts stay comparable.
    """
    if is_git(root):
        out = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard") or ""
        return sorted({p for p in out.split("\0") if p})
    ignored, found = gitignore_names(root), []
    for at, dirs, names in os.walk(root):
        here = os.path.relpath(at, root).replace(os.sep, "/")
        prefix = "" if here == "." else here + "/"
        for d in sorted(dirs):
            if d in VENDORED and d != ".git":
                found.append(f"{prefix}{d}/<directory>")
        dirs[:] = sorted(d for d in dirs if d not in VENDORED and d not in ignored)
        found += [prefix + n for n in names if n not in ignored]
    return sorted(found)


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` (path, size, readable, is_file) with ``content``; what cannot be read turns unreadable.

    Files that are vendored, not files or too large are not opened.
    """

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out, held = [], 0
            start = 0
            for i, path in enumerate(columns["path"]):
                content, readable = None, columns["readable"][i]
                if columns["wanted"][i]:
                    try:
                        content = Path(root, path).read_bytes()
                    except OSError:
                        readable = False
                out.append((content, readable))
                held += len(content or b"")
                if held >= READ_BYTES or i == len(columns["path"]) - 1:
                    part = batch.slice(start, i + 1 - start)
                    arrays = [part.column(0), part.column(1), pa.array([r for _, r in out]), part.column(3), pa.array([c for c, _ in out], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "size", "readable", "is_file", "content"])
                    out, held, start = [], 0, i + 1

    wanted = ~vendored("path") & F.col("readable") & F.col("is_file") & (F.col("size") <= MAX_BYTES)
    rows = listed.select("path", "size", "readable", "is_file", wanted.alias("wanted"))
    return rows.mapInArrow(run, "path string, size bigint, readable boolean, is_file boolean, content binary")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content, skip_reason) of every candidate; content is null where it was not read.

    Every file that is not skipped has its content: one that cannot be read is
    skipped as unreadable, never taken for an empty file.
    """
    root = os.path.abspath(root)
    entries = []
    for p in list_candidates(root):
        full = os.path.join(root, p)
        try:
            size = os.stat(full).st_size
            entries.append((p, size, os.access(full, os.R_OK), os.path.isfile(full)))
        except OSError:
            entries.append((p, None, p.endswith("<directory>"), False))
    listed = spark.createDataFrame(entries, "path string, size bigint, readable boolean, is_file boolean")
    out = read_contents(listed.repartition(max(1, len(entries) // FILES_PER_TASK), "path"), root)
    return out.withColumn("skip_reason", skip_reason("path", "size", "content", F.col("readable"), F.col("is_file")))


def skip_breakdown(found: DataFrame) -> DataFrame:
    """(reason, files) of what was skipped."""
    return found.where("skip_reason is not null").groupBy(F.col("skip_reason").alias("reason")).agg(F.count(F.lit(1)).alias("files"))


class GitLogSource(DataSource):
    """``spark.read.format("git_log")`` with options path and days: a row for each commit and file.

    (commit_id, log_ordinal, author, committed_at, subject, path); merges are
    left out, and a commit without files has one row with a null path.
    """

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "commit_id string, log_ordinal bigint, author string, committed_at string, subject string, path string"

    def reader(self, schema):
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.days = options["path"], int(options.get("days", "180"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        if self.days <= 0:
            return
        form = f"--pretty=format:{RECORD}%H{UNIT}%an{UNIT}%aI{UNIT}%s"
        args = ["git", "-C", self.path, "log", "--no-merges", f"--since={self.days} days ago", "--name-only", form]
        try:
            log = subprocess.Popen(args, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        except OSError:
            return
        ordinal, head, paths = -1, None, 0
        with log, log.stdout as lines:  # line by line: the log is never held whole
            for line in lines:
                text = line.decode("utf-8", "replace").rstrip("\n")
                if text.startswith(RECORD):
                    if head is not None and not paths:
                        yield (*head, None)
                    ordinal += 1
                    commit, author, when, subject = text[1:].split(UNIT, 3)
                    head, paths = (commit, ordinal, author, when, subject), 0
                elif text.strip() and head is not None:
                    paths += 1
                    yield (*head, text)
            if head is not None and not paths:
                yield (*head, None)


def git_log(spark: SparkSession, root: str, days: int = 180) -> DataFrame:
    spark.dataSource.register(GitLogSource)
    return spark.read.format("git_log").option("path", os.path.abspath(root)).option("days", str(days)).load()


def manifest_entry_points(text: DataFrame) -> DataFrame:
    """(path) named by a package.json's main, module, bin and exports (one level deep).

    ``text`` has the column text; broken manifests give nothing.
    """
    t = F.col("text")
    singles = [F.get_json_object(t, f"$.{k}") for k in ("main", "module", "bin", "exports")]
    maps = [F.map_values(F.from_json(F.get_json_object(t, f"$.{k}"), "map<string,string>")) for k in ("bin", "exports")]
    each = F.concat(F.array(*singles), *(F.coalesce(m, F.array().cast("array<string>")) for m in maps))
    paths = text.select(F.explode(each).alias("path")).where(F.col("path").isNotNull() & ~F.startswith(F.ltrim("path"), F.lit("{")))
    return paths.select(F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "").alias("path")).distinct()


def go_module_prefix(text: DataFrame) -> str | None:
    """The module path that a go.mod declares; ``text`` has one row."""
    row = text.select(F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1).alias("p")).first()
    return row["p"] or None if row else None
