"""The ten public queries over an index, as JSON-ready envelopes.

Every envelope says how fresh the index is, and a capped list says how long it
really is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions.paths import module_of
from .operators import calls, components, flow, history, impact, overview, search, structure
from .plans import index
from .session import materialize
from .sources import repository


def capped(df: DataFrame, limit: int) -> tuple[list[dict], dict | None]:
    """At most ``limit`` rows in the frame's order, and the true total if that cut any."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) <= limit:
        return rows, None
    return rows[:limit], {"returned": limit, "total": df.count()}


class Repository:
    """Queries over the index of one checkout; refreshes it when it is slightly stale."""

    def __init__(self, spark: SparkSession, root: str, home: str, refresh: bool = True):
        self.spark, self.root = spark, root
        self.state, self.delta = index.ensure_fresh(spark, root, home) if refresh else index.freshness(spark, root, home)
        self.at = index.load(spark, home)
        self.edges = self.at.edges.drop("src_path")
        self.hits = search.symbol_hits(self.at.symbols, self.at.files)

    def envelope(self, result: dict, truncated: dict | None = None) -> dict:
        meta = self.at.meta
        out = {"index": {"state": self.state, "changed_files": self.delta, "indexed_at": int(meta["indexed_at"]), "head_commit": meta["head_commit"] or None, "files_indexed": int(meta["files_indexed"]), "files_skipped": int(meta["files_skipped"])}, "result": result}
        if truncated:
            out["truncated"] = truncated
        return out

    def _links(self, self_links: bool = False) -> DataFrame:
        return structure.file_links(self.at.imports, self.at.files, self_links=self_links)

    def _pairs(self) -> DataFrame:
        return structure.file_edges(self.at.imports, self.at.files)

    def _texts(self) -> DataFrame:
        """(path, lang, text) of the checkout's indexed files as they are now."""
        found = repository.discover(self.spark, self.root).where("skip_reason is null").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return found.join(self.at.files.select("path", "lang"), "path")

    def _history(self, days: int) -> tuple[DataFrame, DataFrame] | None:
        """(commits, (commit_id, file_id)) of the last days; None without a git history."""
        if not repository.is_git(self.root):
            return None
        log = materialize(repository.git_log(self.spark, self.root, days), "log")
        commits = log.select("commit_id", "author", "log_ordinal", "committed_at", "subject").distinct()
        return commits, log.where("path is not null").select("commit_id", index.file_id("path").alias("file_id")).distinct()

    def _manifest(self) -> tuple[str, ...]:
        try:
            with open(f"{self.root}/package.json") as f:
                text = f.read()
        except OSError:
            return ()
        rows = repository.manifest_entry_points(self.spark.createDataFrame([(text,)], "text string")).collect()
        return tuple(r["path"] for r in rows)

    def get_repo_overview(self) -> dict:
        """Totals, languages, modules, entry points, skipped files by reason and the spread of edge confidence; read from the index alone."""
        a = self.at
        named = lambda df, k, v: {r[k]: r[v] for r in df.collect()}
        result = {
            "totals": named(overview.totals(a.files, a.symbols, a.imports, self.edges), "name", "total"),
            "languages": [r.asDict() for r in overview.languages(a.files, a.symbols).orderBy(F.desc("files"), "lang").collect()],
            "edgeConfidence": named(overview.edge_confidence(self.edges), "confidence", "edges"),
            "internalTargetFraction": overview.internal_fraction(self.edges).first()[0],
            "modules": [r.asDict() for r in overview.top_modules(a.files, a.symbols).orderBy(F.desc("files"), "module").collect()],
            "entryPoints": [r[0] for r in a.files.where(overview.is_entry_point("path", self._manifest())).select("path").orderBy("path").collect()],
            "skipped": json.loads(a.meta["files_skipped_by_reason"]),
            "filesWithParseErrors": a.files.where("error_count > 0").count(),
        }
        return self.envelope(result)

    def search_code(self, query: str, kind: str | None = None, lang: str | None = None, path: str | None = None, limit: int = 50) -> dict:
        """Places of symbols and text lines that match, exact symbol names first; a symbol kind leaves text out."""
        S.within("limit", limit, S.LIMIT)
        rows = [r.asDict() for r in search.search_code(self.hits, self._texts(), query, limit, kind=kind, path=path, lang=lang).collect()]
        total = rows[0].pop("total") if rows else 0
        for r in rows[1:]:
            r.pop("total")
        return self.envelope({"hits": rows}, {"returned": len(rows), "total": total} if total > len(rows) else None)

    def get_symbol(self, name: str, file: str | None = None, limit: int = 50) -> dict:
        """Definition, signature, export status and numbers of callers and callees of every symbol of a name."""
        S.within("limit", limit, S.LIMIT)
        found = search.find_symbols(self.hits, limit, name=name, path_prefix=file)
        rows = [r.asDict() for r in search.callers_and_callees(found, self.edges).orderBy("path", "start_line").collect()]
        total = rows[0]["total"] if rows else 0
        return self.envelope({"matches": rows, "totalMatches": total}, {"returned": len(rows), "total": total} if total > len(rows) else None)

    def describe_module(self, path: str, limit: int = 50) -> dict:
        """Files, public surface, dependencies, dependents and coupling of the files directly inside a directory."""
        S.within("limit", limit, S.LIMIT)
        target = path.removesuffix("/")
        files = self.at.files.withColumn("module", module_of("path"))
        own, cut_files = capped(files.where(F.col("module") == target).select("path").orderBy("path"), limit)
        below = files.where((F.col("module") != target) & (F.lit(target == ".") | F.startswith("module", F.lit(target + "/")))).groupBy("module").count().orderBy("module").collect()
        surface, cut_surface = capped(self.hits.where(F.col("exported") & (module_of("path") == target)).select("name", "kind", "path", F.col("start_line").alias("line")).orderBy("name", "path", "line"), limit)
        modules = structure.module_edges(self._pairs())
        side = lambda me, other: [r.asDict() for r in modules.where(F.col(me) == target).select(F.col(other).alias("module"), F.col("w").alias("weight")).orderBy(F.desc("weight"), "module").collect()]
        metric = structure.coupling(self.at.files, modules).where(F.col("module") == target).first()
        more = sum(r["count"] for r in below)
        result = {"module": target, "files": [r["path"] for r in own], "subModules": [r["module"] for r in below], "publicSurface": surface, "dependencies": side("f", "t"), "dependents": side("t", "f"), "coupling": metric.asDict() if metric else None, "summary": None}
        if not own:
            result["note"] = f"{target} owns no files directly; {more} lie in {len(below)} sub-modules" if below else f"no indexed files under {target}"
        elif more:
            result["note"] = f"only files directly inside {target}; {more} more lie in {len(below)} sub-modules"
        return self.envelope(result, {k: v for k, v in (("files", cut_files), ("publicSurface", cut_surface)) if v} or None)

    def resolve_target(self, target: str) -> dict:
        """A file, else a directory, else a symbol, else unknown."""
        if not self.at.files.where(F.col("path") == target).isEmpty():
            return {"kind": "file", "resolved": target}
        if not self.at.files.where(F.startswith("path", F.lit(target.removesuffix("/") + "/"))).isEmpty():
            return {"kind": "module", "resolved": target.removesuffix("/")}
        found = self.hits.where(F.col("name") == target).select("path", F.col("start_line").alias("line"), "kind").orderBy("path", "line").collect()
        if found:
            return {"kind": "symbol", "resolved": target, "candidates": [r.asDict() for r in found]}
        return {"kind": "unknown", "resolved": target}

    def get_dependencies(self, target: str, direction: str = "out", depth: int = 2, kind: str | None = None, min_confidence: str | None = None, limit: int = 50) -> dict:
        """What a file, directory or symbol depends on, or what depends on it, hop by hop; kind and confidence hold for symbols."""
        S.within("limit", limit, S.LIMIT)
        S.within("depth", depth, S.DEPTH)
        if direction not in ("in", "out"):
            raise ValueError("direction must be in or out")
        found = self.resolve_target(target)
        base = {"target": found, "direction": direction, "depth": depth}
        if found["kind"] == "unknown":
            return self.envelope(base | {"nodes": [], "depthLimited": False})
        if found["kind"] == "symbol":
            walk, limited = structure.symbol_walk(self.edges, self.hits.where(F.col("name") == target).select(F.col("id").alias("node")), depth, direction, kind, min_confidence)
            details = calls.edge_details(walk, self.at.files, self.at.symbols)
            other = ("src_path", "src_name") if direction == "in" else ("dst_path", "dst_symbol_name")
            name = F.col(other[1]) if direction == "in" else F.coalesce(F.col(other[1]), "dst_name")
            rows = details.orderBy("depth", "src_path", "line", "id", "ordinal").select(F.coalesce(other[0], F.lit("(external)")).alias("path"), name.alias("symbolName"), "depth", F.col("kind").alias("via"), "confidence", "line")
        else:
            inside = F.col("path") == found["resolved"] if found["kind"] == "file" else F.startswith("path", F.lit(found["resolved"] + "/"))
            reached, limited = structure.bfs(self._links(), self.at.files.where(inside).select(F.col("id").alias("node")), depth, direction)
            if min_confidence == "exact":
                reached = reached.where(F.lit(False))
            rows = reached.join(self.at.files.select(F.col("id").alias("node"), "path"), "node").orderBy("depth", "path").select("path", F.lit(None).cast("string").alias("symbolName"), "depth", F.lit("imports").alias("via"), F.lit("resolved").alias("confidence"), F.lit(None).cast("int").alias("line"))
        nodes, cut = capped(rows, limit)
        return self.envelope(base | {"nodes": nodes, "depthLimited": limited}, cut)

    def impact_of(self, symbol: str, file: str | None = None, max_depth: int = 3, limit: int = 50) -> dict:
        """Who refers to a symbol over several hops, bucketed by how sure the references are."""
        S.within("limit", limit, S.LIMIT)
        S.within("max_depth", max_depth, S.DEPTH)
        matches = self.hits.where(search.symbol_filter(name=symbol, path_prefix=file))
        walk, limited = structure.symbol_walk(self.edges, matches.select(F.col("id").alias("node")), max_depth, "in")
        refs = impact.references(walk, self.at.files)
        counts = impact.buckets(refs).first().asDict()
        details = calls.edge_details(walk, self.at.files, self.at.symbols)
        rows, cut = capped(details.orderBy("depth", "src_path", "line", "id", "ordinal").select(F.col("src_path").alias("path"), F.col("src_name").alias("symbolName"), "depth", F.col("kind").alias("via"), "confidence", "line"), limit)
        result = {
            "symbol": symbol,
            "matchedSymbols": [r.asDict() for r in matches.select("path", F.col("start_line").alias("line"), "kind", "exported").orderBy("path", "line").collect()],
            "totalReferences": counts.pop("total"),
            "buckets": counts,
            "byModule": [r.asDict() for r in impact.by_module(refs).orderBy(F.desc("count"), "first").drop("first").collect()],
            "references": rows,
            "exportedFromEntryPoint": not matches.where(F.col("exported") & overview.is_entry_point("path", self._manifest())).isEmpty(),
            "maxDepth": max_depth,
            "depthLimited": limited,
        }
        if not result["matchedSymbols"]:
            result["note"] = f"symbol {symbol} is not in the index"
        return self.envelope(result, cut)

    def trace_flow(self, entry: str, file: str | None = None, max_depth: int = 4, limit: int = 50) -> dict:
        """The tree of calls from a symbol; tells symbols expanded elsewhere and where depth or budget cut it."""
        S.within("limit", limit, S.LIMIT)
        S.within("max_depth", max_depth, S.DEPTH)
        details = calls.edge_details(self.edges, self.at.files, self.at.symbols)
        tree = flow.trace_flow(self.hits, details, entry, path_prefix=file, max_depth=max_depth, limit=limit)
        if tree is None:
            return self.envelope({"entry": entry, "root": None, "totalNodes": 0, "depthLimited": False, "limitReached": False, "note": f"{entry} is not in the index"})
        nodes: dict[int, dict] = {}
        for node, parent, _, _, name, path, line, confidence, crosses, repeated in tree.rows:
            nodes[node] = {"name": name, "path": path, "line": line, "confidence": confidence, "crossesModule": crosses, "repeated": repeated, "calls": []}
            if parent is not None:
                nodes[parent]["calls"].append(nodes[node])
        return self.envelope({"entry": entry, "root": nodes[0], "totalNodes": len(nodes), "depthLimited": tree.depth_limited, "limitReached": tree.limit_reached})

    def find_cycles(self, scope: str = "module", min_size: int = 2, limit: int = 50) -> dict:
        """Circular dependencies between directories or files, the largest first; a module cycle without a cycle of files is marked as an artifact."""
        S.within("limit", limit, S.LIMIT)
        S.within("min_size", min_size, S.MIN_SIZE)
        if scope not in ("module", "file"):
            raise ValueError("scope must be module or file")
        pairs = self._pairs()
        edges = structure.module_edges(pairs).toDF("src", "dst", "w") if scope == "module" else pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("w"))
        members = components.strong_components(edges)
        found = components.cycles(members, edges, min_size)
        if scope == "module":
            file_members = components.strong_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("path"))
            loops = self._links(True).where("src = dst").select(F.col("src").alias("id")).join(self.at.files, "id").select("path")
            found = found.join(components.artifacts(members, file_members, loops), "component")
        rows, cut = capped(found.orderBy(F.desc("size"), F.desc("internal_edges"), F.col("members")[0]), limit)
        if scope == "module" and rows:
            hops = components.cycle_hops(members, edges.toDF("f", "t", "w"), pairs).where(F.col("component").isin([r["component"] for r in rows])).orderBy("f", "t", "rank").collect()
            for r in rows:
                r["hops"] = [h.asDict() for h in hops if h["component"] == r["component"]]
        return self.envelope({"scope": scope, "cycles": rows, "totalCycles": cut["total"] if cut else len(rows)}, cut)

    def get_coupling(self, limit: int = 50) -> dict:
        """Afferent and efferent coupling and instability of every module, and the heaviest dependencies between modules."""
        S.within("limit", limit, S.LIMIT)
        modules = structure.module_edges(self._pairs())
        rows, cut = capped(structure.coupling(self.at.files, modules).orderBy(F.desc(F.col("ca") + F.col("ce")), "module"), limit)
        heavy, cut_pairs = capped(modules.orderBy(F.desc("w"), "f", "t"), limit)
        return self.envelope({"modules": rows, "heaviestPairs": heavy}, {k: v for k, v in (("modules", cut), ("heaviestPairs", cut_pairs)) if v} or None)

    def find_hotspots(self, limit: int = 50, window_days: int = 180) -> dict:
        """Files by complexity times churn with every raw signal, and files that change together without a dependency."""
        S.within("limit", limit, S.LIMIT)
        S.within("window_days", window_days, S.WINDOW_DAYS)
        a, links = self.at, self._links(True)
        cyclic = components.strong_components(links.where("src <> dst")).select(F.col("node").alias("file_id"))
        notes, past, hidden, totals = [], None, [], {"total_commits": 0, "skipped_large_commits": 0}
        log = self._history(window_days)
        cut_hidden = None
        if log is not None:
            commits, touched = log
            past = history.churn(commits, touched).select("file_id", "commits", "bug_fixes")
            totals = history.commit_totals(commits, touched).first().asDict()
            known = touched.join(a.files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
            sizes = touched.groupBy("commit_id").count().where(F.col("count") <= history.LARGE_COMMIT).select("commit_id")
            pairs = history.co_changes(commits.join(sizes, "commit_id", "left_semi"), known, support=history.MIN_SUPPORT)
            named = history.hidden_coupling(pairs, links.where("src <> dst"))
            f = a.files.select("id", "path")
            named = named.join(f.toDF("a", "pa"), "a").join(f.toDF("b", "pb"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "commits")
            hidden, cut_hidden = capped(named.orderBy(F.desc("commits"), "a", "b"), limit)
        else:
            notes.append("no git history: files are ranked by complexity alone")
        if a.files.where("loc > 0").isEmpty():
            notes.append("every indexed file has 0 lines of code")
        rows, cut = capped(history.hotspots(a.files, a.symbols, links, cyclic, past).orderBy(F.desc("score"), "path"), limit)
        result = {"hotspots": rows, "gitAvailable": log is not None, "totalCommits": totals["total_commits"], "skippedLargeCommits": totals["skipped_large_commits"], "hiddenCoupling": hidden, "notes": notes}
        return self.envelope(result, {k: v for k, v in (("hotspots", cut), ("hiddenCoupling", cut_hidden)) if v} or None)


TOOLS = ("get_repo_overview", "search_code", "get_symbol", "describe_module", "get_dependencies", "impact_of", "trace_flow", "find_cycles", "get_coupling", "find_hotspots")


def to_json(envelope: dict) -> str:
    return json.dumps(envelope, indent=2, ensure_ascii=False, default=str)
