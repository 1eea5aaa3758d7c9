"""The index: cold builds, incremental refreshes, and their commit protocol.

An index is a folder of immutable snapshots and one ``meta`` table that names
the current one.  A build or refresh writes a whole new snapshot, then the new
meta beside the old, and then puts it in the old one's place, so that a crash
at any point leaves either the old index or the new one.  The snapshot before
the current one stays for readers that still use it; older ones are deleted.
Identifiers are hashes of a path and a position, so that a refresh and a full
rebuild agree on them.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.parse import parse_files
from ..operators import calls, incremental, resolve
from ..schemas import META, SCHEMA_VERSION
from ..session import discard, materialize
from ..sources import repository

TABLES = ("files", "symbols", "imports", "edges")
REFRESH_INLINE = 50  # up to so many changed files a query refreshes by itself


class IndexError_(RuntimeError):
    """The index cannot be used as it is."""


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class Snapshot:
    files: DataFrame  # id, path, lang, content_hash, loc, error_count
    symbols: DataFrame  # id, file_id, name, kind, start_line, end_line, exported, signature, parent_name
    imports: DataFrame  # id, file_id, path, lang, specifier, kind, line, resolved, resolved_file_id, confidence
    edges: DataFrame  # as from call resolution, with src_path
    meta: dict[str, str]


def file_id(path) -> F.Column:
    return F.xxhash64(F.col(path) if isinstance(path, str) else path)


def nodes(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, symbols, raw imports, call sites) of parsed files."""
    files = parsed.select(file_id("path").alias("id"), "path", "lang", "content_hash", "loc", F.size("errors").alias("error_count"))

    def flat(column: str, tag: str) -> DataFrame:
        rows = parsed.select("path", "lang", F.posexplode(column).alias("pos", "x"))
        return rows.select(F.xxhash64("path", F.lit(tag), "pos").alias("id"), file_id("path").alias("file_id"), "path", "lang", "x.*")

    symbols = flat("symbols", "s").select("id", "file_id", "name", "kind", "start_line", "end_line", "exported", "signature", "parent_name")
    sites = flat("call_sites", "c").select("id", "file_id", "name", F.col("enclosing_symbol").alias("enclosing"), "kind", "line")
    return files, symbols, flat("imports", "i"), sites


def resolved_imports(raw: DataFrame, known: DataFrame, go_prefix: str | None) -> DataFrame:
    found = resolve.resolve_imports(raw.select("id", "path", "lang", "specifier"), known, go_prefix)
    return raw.join(found, "id").select("id", "file_id", "path", "lang", "specifier", "kind", "line", "resolved", file_id("resolved").alias("_f"), "confidence").withColumn(
        "resolved_file_id", F.when(F.col("resolved").isNotNull(), F.col("_f"))
    ).drop("_f")


def _go_prefix(found: DataFrame) -> str | None:
    mod = found.where("path = 'go.mod' and content is not null").select(F.col("content").cast("string").alias("text"))
    return repository.go_module_prefix(mod)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _meta_path(spark: SparkSession, home: str) -> str | None:
    """The meta table; the one that a crash left beside it where there is no other."""
    for name in ("meta", "meta-next"):
        if _exists(spark, f"{home}/{name}/_SUCCESS"):
            return f"{home}/{name}"
    return None


def _write(spark: SparkSession, home: str, tables: dict[str, DataFrame], meta: dict[str, str]) -> None:
    snapshot = f"{home}/snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{snapshot}/{name}")
    rows = {**meta, "schema_version": str(SCHEMA_VERSION), "snapshot": snapshot, "indexed_at": str(int(time.time() * 1000)), "index_complete": "true"}
    before = _meta_path(spark, home)
    last = {r["value"] for r in spark.read.schema(META).parquet(before).where("key = 'snapshot'").collect()} if before else set()
    if before == f"{home}/meta":
        _remove(spark, f"{home}/meta-next")
    else:
        _remove(spark, f"{home}/meta")
    fresh = "meta-next" if before == f"{home}/meta" else "meta"
    spark.createDataFrame(sorted(rows.items()), META).coalesce(1).write.parquet(f"{home}/{fresh}")
    if fresh == "meta-next":
        _remove(spark, f"{home}/meta")
        fs, source = _file_system(spark, f"{home}/meta-next")
        fs.rename(source, _file_system(spark, f"{home}/meta")[1])
    else:
        _remove(spark, f"{home}/meta-next")
    fs, folder = _file_system(spark, home)
    names = {x.rstrip("/").rsplit("/", 1)[-1] for x in [snapshot, *last]}
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("snapshot-") and status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def _meta_of(root: str, found: DataFrame) -> dict[str, str]:
    import json

    skipped = {r["reason"]: r["files"] for r in repository.skip_breakdown(found).collect()}
    indexed = found.where("skip_reason is null").count()
    return {
        "repo_root": root,
        "head_commit": repository.head_commit(root) or "",
        "files_indexed": str(indexed),
        "files_skipped": str(sum(skipped.values())),
        "files_skipped_by_reason": json.dumps(skipped, sort_keys=True),
    }


def _report(spark: SparkSession, home: str, started: float) -> dict[str, int]:
    at = load(spark, home)
    errors = at.files.agg(F.coalesce(F.sum("error_count"), F.lit(0))).first()[0]
    counts = {"files_indexed": int(at.meta["files_indexed"]), "files_skipped": int(at.meta["files_skipped"])}
    return counts | {"symbols": at.symbols.count(), "edges": at.edges.count(), "parse_errors": errors, "duration_ms": int(1000 * (time.time() - started))}


def build(spark: SparkSession, root: str, home: str) -> dict[str, int]:
    """Indexes everything from scratch and reports what it found."""
    started = time.time()
    found = materialize(repository.discover(spark, root), "found")
    parsed = materialize(parse_files(found.where("skip_reason is null").select("path", "content")), "parsed")
    files, symbols, raw, sites = nodes(parsed)
    imports = materialize(resolved_imports(raw, files.select("path"), _go_prefix(found)), "imports")
    edges = _with_source(calls.resolve_calls(sites, symbols, imports, files), files)
    _write(spark, home, {"files": files, "symbols": symbols, "imports": imports, "edges": edges}, _meta_of(root, found))
    discard(found, parsed, imports)
    return _report(spark, home, started)


def _with_source(edges: DataFrame, files: DataFrame) -> DataFrame:
    return edges.join(files.select(F.col("id").alias("src_file_id"), F.col("path").alias("src_path")), "src_file_id")


def load(spark: SparkSession, home: str) -> Snapshot:
    """The current snapshot; refuses another schema version and an unfinished index."""
    path = _meta_path(spark, home)
    if path is None:
        raise IndexError_("the index is missing or incomplete; build it first")
    try:
        meta = {r["key"]: r["value"] for r in spark.read.schema(META).parquet(path).collect()}
    except Exception as e:  # noqa: BLE001  whatever the file system or the format reports
        raise IndexError_(f"the index at {home} cannot be read and may be corrupt; rebuild it with `index --full` ({str(e)[:200]})") from e
    if meta.get("schema_version") != str(SCHEMA_VERSION):
        raise IndexError_(f"the index has schema version {meta.get('schema_version')}, not {SCHEMA_VERSION}; rebuild it")
    if meta.get("index_complete") != "true":
        raise IndexError_("the index is incomplete; rebuild it")
    try:
        tables = {t: spark.read.parquet(f"{meta['snapshot']}/{t}") for t in TABLES}
    except Exception as e:  # noqa: BLE001  whatever the file system or the format reports
        raise IndexError_(f"the index at {home} cannot be read and may be corrupt; rebuild it with `index --full` ({str(e)[:200]})") from e
    return Snapshot(**tables, meta=meta)


def changes(spark: SparkSession, snapshot: Snapshot, found: DataFrame) -> DataFrame:
    now = found.where("skip_reason is null").select("path", F.sha2(F.make_valid_utf8(F.col("content").cast("string")), 256).alias("content_hash"))
    return incremental.change_set(now, snapshot.files.select("path", "content_hash"))


def refresh(spark: SparkSession, root: str, home: str) -> dict[str, int]:
    """Brings the index up to date by rebuilding what the changes touch."""
    try:
        old = load(spark, home)
    except IndexError_ as e:
        if "schema version" in str(e):
            raise
        return build(spark, root, home) | {"fell_back_to_cold": 1}
    started = time.time()
    found = materialize(repository.discover(spark, root), "found")
    delta = materialize(changes(spark, old, found), "delta")
    counts = {r["status"]: r["count"] for r in delta.groupBy("status").count().collect()}
    if not counts.get("changed") and not counts.get("deleted"):
        discard(found, delta)
        return {"changed": 0, "deleted": 0, "unchanged": counts.get("unchanged", 0), "reparsed": 0, "fell_back_to_cold": 0}
    deleted = delta.where("status = 'deleted'").select("path")
    dirty = delta.where("status = 'changed'").select("path")
    sources = found.where("skip_reason is null").select("path", "content")
    known = sources.select("path")
    prefix = _go_prefix(found)
    survivors = old.imports.join(deleted, "path", "left_anti").join(dirty, "path", "left_anti")
    moved = incremental.changed_resolutions(survivors.select("id", "path", "resolved", "confidence"), resolve.resolve_imports(survivors.select("id", "path", "lang", "specifier"), known, prefix))
    from ..functions.languages import language_of

    every = old.files.select("path", "lang").unionByName(known.select("path", language_of("path").alias("lang"))).distinct()
    touched = incremental.dilation(delta, old.imports.select("path", "resolved"), every).unionByName(moved).distinct()
    touched = materialize(touched, "touched")
    parsed = materialize(parse_files(sources.join(touched, "path", "left_semi")), "parsed")
    files, symbols, raw, sites = nodes(parsed)
    gone = deleted.unionByName(touched)
    gone_ids = gone.select(file_id("path").alias("file_id"))
    all_files = materialize(incremental.replace_rows(old.files, files, gone), "files")
    all_symbols = materialize(incremental.replace_rows(old.symbols, symbols, gone_ids, "file_id"), "symbols")
    imports = materialize(resolved_imports(raw, known, prefix), "imports")
    all_imports = materialize(incremental.replace_rows(old.imports, imports, gone), "imports")
    edges = _with_source(calls.resolve_calls(sites, all_symbols, all_imports, all_files), all_files)
    kept = old.edges.join(gone.select(F.col("path").alias("src_path")).distinct(), "src_path", "left_anti")
    kept = incremental.unlink_targets(kept.select(*old.edges.columns), deleted.select(file_id("path").alias("id")))
    all_edges = kept.unionByName(edges.select(*old.edges.columns))
    _write(spark, home, {"files": all_files, "symbols": all_symbols, "imports": all_imports, "edges": all_edges}, _meta_of(root, found))
    out = {"changed": counts.get("changed", 0), "deleted": counts.get("deleted", 0), "unchanged": counts.get("unchanged", 0), "reparsed": parsed.count(), "fell_back_to_cold": 0} | _report(spark, home, started)
    discard(found, delta, touched, parsed, imports, all_files, all_symbols, all_imports)
    return out


def freshness(spark: SparkSession, root: str, home: str) -> tuple[str, int]:
    """(missing, incomplete, stale or current; changed and deleted files).

    A clean checkout at the indexed commit is current without hashing a file.
    """
    if not _exists(spark, home):
        return "missing", 0
    try:
        snapshot = load(spark, home)
    except IndexError_ as e:
        if "schema version" in str(e):
            raise
        return "incomplete", 0
    head = repository.head_commit(root)
    if head and head == snapshot.meta.get("head_commit") and repository.is_clean(root):
        return "current", 0
    delta = changes(spark, snapshot, repository.discover(spark, root)).where("status <> 'unchanged'").count()
    return ("stale" if delta else "current"), delta


def ensure_fresh(spark: SparkSession, root: str, home: str) -> tuple[str, int]:
    """Builds what is missing, refreshes a small delta, labels a large one stale."""
    state, delta = freshness(spark, root, home)
    if state in ("missing", "incomplete"):
        build(spark, root, home)
        return "current", 0
    if state == "stale" and delta < REFRESH_INLINE:
        refresh(spark, root, home)
        return "current", 0
    return state, delta
