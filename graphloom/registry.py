"""Every registered query of the graph engine, and its equivalent SQL.

Queries run over the projection of the driver's tables (``plans.projection``);
results are whole unless the feature itself is a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import module_of
from .functions.scores import is_bug_fix
from .operators import calls, components, flow, history, impact, overview, search, structure
from .plans.oracle import FILE_CYCLES, ORACLES
from .plans.projection import Graph, project
from .plans.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    """Registers a query over the projected graph under its own name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir))
    return f


def _stored(g: Graph, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return stored(g.files.sparkSession, g.folder, name, build)


def _edges(g: Graph) -> DataFrame:
    return _stored(g, "edges", lambda: calls.resolve_calls(g.calls, g.symbols, g.imports, g.files))


def _details(g: Graph) -> DataFrame:
    return _stored(g, "details", lambda: calls.edge_details(_edges(g), g.files, g.symbols))


def _pairs(g: Graph) -> DataFrame:
    return _stored(g, "pairs", lambda: structure.file_edges(g.imports, g.files))


def _links(g: Graph) -> DataFrame:
    return _pairs(g).select("src", "dst")


def _hits(g: Graph) -> DataFrame:
    return search.symbol_hits(g.symbols, g.files)


def _window(g: Graph, days: int = 730) -> DataFrame:
    """Commits of the log's last days (the log itself says when it ends)."""
    end = g.commits.agg(F.max("committed_at").alias("end"))
    return g.commits.crossJoin(F.broadcast(end)).where(F.col("committed_at") >= F.col("end") - F.make_dt_interval(F.lit(days))).drop("end")


@query
def coupling(g: Graph) -> DataFrame:
    return structure.coupling(g.files, structure.module_edges(_pairs(g)))


@query
def file_edges(g: Graph) -> DataFrame:
    return _pairs(g).select("a", "b")


@query
def module_edges(g: Graph) -> DataFrame:
    return structure.module_edges(_pairs(g))


@query
def heaviest_pairs(g: Graph) -> DataFrame:
    return structure.module_edges(_pairs(g)).orderBy(F.desc("w"), "f", "t").limit(50)


@query
def overview_totals(g: Graph) -> DataFrame:
    return overview.totals(g.files, g.symbols, g.imports, _edges(g))


@query
def language_breakdown(g: Graph) -> DataFrame:
    return overview.languages(g.files, g.symbols)


@query
def edge_confidence(g: Graph) -> DataFrame:
    return overview.edge_confidence(_edges(g))


@query
def internal_target_fraction(g: Graph) -> DataFrame:
    return overview.internal_fraction(_edges(g))


@query
def top_modules(g: Graph) -> DataFrame:
    return overview.top_modules(g.files, g.symbols)


@query
def entry_points(g: Graph) -> DataFrame:
    extra = ("pkg0/blue_widget_1.py",)
    return g.files.where(overview.is_entry_point("path", extra) | F.regexp_like("path", F.lit(r"0\.ts$"))).select("path")


@query
def symbol_search_exact(g: Graph) -> DataFrame:
    found = search.find_symbols(_hits(g), 50, name="sym_8", exported=False)
    return found.select("id", "name", "path", "total")


@query
def symbol_search_partial(g: Graph) -> DataFrame:
    found = search.find_symbols(_hits(g), 200, contains="YM_1", kind="function", path_prefix="PKG1", lang="python")
    return found.select("id", "name", "path", "total")


@query
def symbol_callers_callees(g: Graph) -> DataFrame:
    return search.callers_and_callees(g.symbols.select("id", "name"), _edges(g))


@query
def module_surface(g: Graph) -> DataFrame:
    return _hits(g).where("exported").select(module_of("path").alias("module"), "name", "kind", "path", "start_line")


@query
def module_neighbours(g: Graph) -> DataFrame:
    w = structure.module_edges(_pairs(g))
    out = w.select(F.col("f").alias("module"), F.lit("out").alias("direction"), F.col("t").alias("other"), "w")
    return out.unionByName(w.select(F.col("t").alias("module"), F.lit("in").alias("direction"), F.col("f").alias("other"), "w"))


@query
def sub_modules(g: Graph) -> DataFrame:
    """Files below every module: each file counts for each of its ancestors."""
    up = g.files.select(module_of("path").alias("own")).select("own", F.explode(F.expr("transform(sequence(1, size(split(own, '/'))), n -> array_join(slice(split(own, '/'), 1, n), '/'))")).alias("module"))
    return up.where("own <> module").groupBy("module").agg(F.countDistinct("own").alias("sub_modules"), F.count(F.lit(1)).alias("additional_files"))


@query
def call_edges(g: Graph) -> DataFrame:
    return _edges(g)


@query
def edge_details(g: Graph) -> DataFrame:
    return _details(g).select("id", "ordinal", "src_path", "src_name", "dst_path", "dst_symbol_name", "dst_name", "kind", "confidence", "line")


@query
def same_package_pairs(g: Graph) -> DataFrame:
    return calls.same_package_pairs(g.files)


@query
def import_targets(g: Graph) -> DataFrame:
    return calls.import_targets(g.imports, g.files)


def _start_file(g: Graph) -> DataFrame:
    return g.files.where("id = 30").select(F.col("id").alias("node"))


def _reached(g: Graph, direction: str) -> DataFrame:
    found, _ = structure.bfs(_links(g), _start_file(g), 4, direction)
    return found.join(g.files.select(F.col("id").alias("node"), "path"), "node").select("path", "depth")


@query
def deps_out(g: Graph) -> DataFrame:
    return _reached(g, "out")


@query
def deps_in(g: Graph) -> DataFrame:
    return _reached(g, "in")


def _start_symbols(g: Graph) -> DataFrame:
    return g.symbols.where("name = 'sym_8'").select(F.col("id").alias("node"))


@query
def symbol_walk(g: Graph) -> DataFrame:
    found, _ = structure.symbol_walk(_edges(g), _start_symbols(g), 3, "out")
    return found.select("id", "ordinal", "dst_name", "confidence", "depth")


@query
def symbol_walk_filtered(g: Graph) -> DataFrame:
    found, _ = structure.symbol_walk(_edges(g), _start_symbols(g), 3, "out", "calls", "heuristic")
    return found.select("id", "ordinal", "dst_name", "confidence", "depth")


def _references(g: Graph) -> DataFrame:
    found, _ = structure.symbol_walk(_edges(g), _start_symbols(g), 3, "in")
    return impact.references(found, g.files)


@query
def impact_buckets(g: Graph) -> DataFrame:
    return impact.buckets(_references(g))


@query
def impact_by_module(g: Graph) -> DataFrame:
    return impact.by_module(_references(g)).drop("first")


@query
def flow_tree(g: Graph) -> DataFrame:
    tree = flow.trace_flow(_hits(g), _details(g), "sym_21", max_depth=6, limit=100)
    rows = tree.rows if tree else []
    return g.files.sparkSession.createDataFrame(rows, flow.NODE)


def _file_members(g: Graph) -> DataFrame:
    found = components.strong_components(_links(g))
    return found.join(g.files.select(F.col("id").alias("node"), "path"), "node")


@query
def file_cycles(g: Graph) -> DataFrame:
    e = _pairs(g).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("w"))
    found = components.cycles(components.strong_components(e), e)
    return found.select(F.array_join("members", ",").alias("members"), F.col("size").cast("bigint").alias("size"), "internal_edges")


def _module_members(g: Graph) -> tuple[DataFrame, DataFrame]:
    e = structure.module_edges(_pairs(g)).toDF("src", "dst", "w")
    return components.strong_components(e), e


@query
def module_cycles(g: Graph) -> DataFrame:
    members, e = _module_members(g)
    found = components.cycles(members, e)
    return found.select(F.array_join("members", ",").alias("members"), F.col("size").cast("bigint").alias("size"), "internal_edges")


@query
def cycle_hops(g: Graph) -> DataFrame:
    members, e = _module_members(g)
    return components.cycle_hops(members, e.toDF("f", "t", "w"), _pairs(g)).select("f", "t", "n_pairs", "via_from", "via_to")


@query
def cycle_artifact(g: Graph) -> DataFrame:
    members, _ = _module_members(g)
    loops = g.imports.where("file_id = resolved_file_id").select(F.col("file_id").alias("id")).join(g.files, "id").select("path")
    return components.artifacts(members, _file_members(g).select("path"), loops)


@query
def churn(g: Graph) -> DataFrame:
    return history.churn(_window(g), g.commit_files)


@query
def bug_fix_commits(g: Graph) -> DataFrame:
    return g.commits.where(is_bug_fix("subject")).select("commit_id", "subject")


@query
def commit_totals(g: Graph) -> DataFrame:
    return history.commit_totals(g.commits, g.commit_files, large=6)


@query
def co_change(g: Graph) -> DataFrame:
    return history.co_changes(g.commits, g.commit_files, support=2)


@query
def hidden_coupling(g: Graph) -> DataFrame:
    return history.hidden_coupling(history.co_changes(g.commits, g.commit_files, support=2), _links(g))


@query
def hotspots(g: Graph) -> DataFrame:
    links = structure.file_links(g.imports, g.files, self_links=True)
    cyclic = components.strong_components(links.where("src <> dst")).select(F.col("node").alias("file_id"))
    found = history.hotspots(g.files, g.symbols, links, cyclic, history.churn(g.commits, g.commit_files).select("file_id", "commits", "bug_fixes"))
    return found.select("path", "loc", "symbols", "fan_in", "fan_out", F.col("in_cycle").cast("int").alias("in_cycle"), "commits", "bug_fixes", "score")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "lang", "text")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.text_lines(_texts(spark, sf_dir), "LICENSED under")
    return found.select("path", F.col("line").cast("bigint").alias("line"), "snippet")


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(project(spark, sf_dir))
    found = search.search_code(hits, _texts(spark, sf_dir), "sym_1", 500)
    return found.select("path", F.col("line").cast("bigint").alias("line"), "kind", "symbol_name", "snippet", F.col("score").cast("bigint").alias("score"), "total")


QUERIES["text_search"] = text_search
QUERIES["code_search"] = code_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registry_api, registry_more

    return QUERIES | registry_more.QUERIES | registry_api.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import registry_api

    return {name: sql for name, sql in (ORACLES | registry_api.ORACLES).items() if name in queries()}
