"""The public queries over the projected graph: their lists, orders, limits and totals as rows.

Every query calls the method that answers a user and lays its envelope out as
rows, so that plain SQL can check it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .api import Repository
from .operators import incremental, search
from .plans.index import Snapshot
from .plans.oracle import FILE_MEMBERS, HOTSPOT_ROWS, IMPACT, MODULE_CYCLES, bfs_sql, flow_sql, module, sql, walk_sql
from .plans.projection import Graph, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: (part of the answer, place in its list, what stands there, its number)
ROWS = "section string, position bigint, key string, value double"


class Projected(Repository):
    """The public queries over a projected graph instead of an index of a checkout."""

    def __init__(self, g: Graph):
        self.g, self.spark, self.root, self.state, self.delta = g, g.files.sparkSession, "", "current", 0
        meta = {"indexed_at": "0", "head_commit": "", "files_indexed": "0", "files_skipped": "0", "files_skipped_by_reason": "{}"}
        self.at = Snapshot(g.files, g.symbols, g.imports, None, meta)
        self.hits = search.symbol_hits(g.symbols, g.files)

    @functools.cached_property
    def edges(self) -> DataFrame:
        """Resolved for the queries that read them; imports alone make cycles and coupling."""
        return registry._edges(self.g)

    def _texts(self) -> DataFrame:
        return registry._texts(self.spark, self.g.folder)

    def _pairs(self) -> DataFrame:
        return registry._pairs(self.g)

    def _manifest(self) -> tuple[str, ...]:
        return ()

    def _history(self, days: int) -> tuple[DataFrame, DataFrame]:
        return registry._window(self.g, days), self.g.commit_files


def query(oracle: str | None = None):
    """Registers a function from a repository to rows of ``ROWS``."""

    def add(f: Callable[[Projected], list[tuple]]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: spark.createDataFrame(f(Projected(project(spark, sf_dir))), ROWS)
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def listed(section: str, rows: list, key: Callable, value: Callable = lambda r: 0.0) -> list[tuple]:
    return [(section, i + 1, key(r), float(value(r))) for i, r in enumerate(rows)]


def numbers(section: str, found: dict) -> list[tuple]:
    return [(section, 0, k, float(v)) for k, v in found.items()]


def total(found: dict, part: str | None = None) -> list[tuple]:
    """The true total of a list that was cut."""
    cut = found.get("truncated") or {}
    cut = cut.get(part, {}) if part else cut
    return [(f"total {part or 'rows'}", 0, "", float(cut["total"]))] if cut else []


_TOTAL = "select 'total {0}', cast(0 as bigint), '', cast(count(*) as double) from {1} having count(*)>{2}"


@query(
    sql(
        f"""select 'totals' as section, cast(0 as bigint) as position, k as key, cast(v as double) as value from (select 'files' as k, count(*) as v from files union all select 'symbols', count(*) from symbols union all select 'imports', count(*) from imports union all select 'edges', count(*) from edges union all select 'parse_errors', sum(error_count) from files)
union all select 'languages', row_number() over (order by count(distinct f.id) desc, lang nulls first), coalesce(lang,'-'), cast(count(s.id) as double) from files f left join symbols s on s.file_id=f.id group by lang
union all select 'confidence', 0, t.c, cast(count(e.id) as double) from (values ('exact'),('resolved'),('heuristic'),('ambiguous'),('unresolved')) t(c) left join edges e on e.confidence=t.c group by 1,2,3
union all select 'modules', row_number() over (order by count(distinct f.id) desc, split_part(path,'/',1)), split_part(path,'/',1), cast(count(s.id) as double) from files f left join symbols s on s.file_id=f.id group by split_part(path,'/',1)
union all select 'parse errors', 0, 'files', cast(count(*) as double) from files where error_count>0"""
    )
)
def get_repo_overview(r: Projected) -> list[tuple]:
    o = r.get_repo_overview()["result"]
    out = numbers("totals", o["totals"]) + numbers("confidence", o["edgeConfidence"]) + [("parse errors", 0, "files", float(o["filesWithParseErrors"]))]
    return out + listed("languages", o["languages"], lambda x: x["lang"] or "-", lambda x: x["symbols"]) + listed("modules", o["modules"], lambda x: x["module"], lambda x: x["symbols"])


_HITS = registry.ORACLES["code_search"].replace(" order by score desc, path, line limit 500", "")


@query(f"select 'hits' as section, row_number() over (order by score desc, path, line) as position, path||':'||cast(line as varchar)||' '||kind||' '||snippet as key, cast(score as double) as value from ({_HITS}) order by score desc, path, line limit 50")
def search_code(r: Projected) -> list[tuple]:
    return listed("hits", r.search_code("sym_1", limit=50)["result"]["hits"], lambda x: f"{x['path']}:{x['line']} {x['kind']} {x['snippet']}", lambda x: x["score"])


@query(
    sql(
        "select 'symbols' as section, row_number() over (order by score desc, path, start_line) as position, path||':'||cast(start_line as varchar)||' '||name as key, cast(score as double) as value from"
        " (select f.path, s.start_line, s.name, case when s.name='sym_1' then 100 else 60 end as score from symbols s join files f on f.id=s.file_id where contains(lower(s.name),'sym_1') and s.kind='class' and starts_with(lower(f.path),'pkg2') and f.lang='java') order by score desc, path, start_line limit 500"
    )
)
def search_symbols_only(r: Projected) -> list[tuple]:
    """A symbol kind leaves the texts out."""
    hits = r.search_code("sym_1", kind="class", lang="java", path="pkg2", limit=500)["result"]["hits"]
    return listed("symbols", hits, lambda x: f"{x['path']}:{x['line']} {x['symbol_name']}", lambda x: x["score"])


@query(
    sql(
        """select section, position, key, value from (select 'matches' as section, row_number() over (order by x.path, x.start_line) as position, x.path||':'||cast(x.start_line as varchar)||' '||cast(coalesce(i.n,0) as varchar) as key, cast(coalesce(o.n,0) as double) as value
 from (select s.id, s.start_line, f.path from symbols s join files f on f.id=s.file_id where s.name='sym_8' order by f.path, s.id limit 50) x
 left join (select dst_symbol_id as id, count(*) as n from edges group by 1) i on i.id=x.id left join (select src_symbol_id as id, count(*) as n from edges group by 1) o on o.id=x.id)
union all """
        + _TOTAL.format("rows", "symbols where name='sym_8'", 50)
    )
)
def get_symbol(r: Projected) -> list[tuple]:
    found = r.get_symbol("sym_8", limit=50)
    return listed("matches", found["result"]["matches"], lambda x: f"{x['path']}:{x['start_line']} {x['caller_count']}", lambda x: x["callee_count"]) + total(found)


@query(
    sql(
        f"""select * from (select 'files' as section, row_number() over (order by path) as position, path as key, cast(0 as double) as value from fm where module='pkg1'
union all select 'sub-modules', row_number() over (order by module), module, 0 from (select distinct module from fm where starts_with(module,'pkg1/'))
union all (select 'surface', row_number() over (order by s.name, f.path, s.start_line), s.name||' '||s.kind||' '||f.path, s.start_line from symbols s join files f on f.id=s.file_id where s.exported and {module('f.path')}='pkg1' order by s.name, f.path, s.start_line limit 50)
union all select 'dependencies', row_number() over (order by w desc, t), t, w from me where f='pkg1' union all select 'dependents', row_number() over (order by w desc, f), f, w from me where t='pkg1'
union all select 'coupling', 0, 'ca', count(*) from me where t='pkg1' union all select 'coupling', 0, 'ce', count(*) from me where f='pkg1')"""
    )
)
def describe_module(r: Projected) -> list[tuple]:
    m = r.describe_module("pkg1/", limit=50)["result"]
    out = listed("files", m["files"], lambda x: x) + listed("sub-modules", m["subModules"], lambda x: x)
    out += listed("surface", m["publicSurface"], lambda x: f"{x['name']} {x['kind']} {x['path']}", lambda x: x["line"])
    for side in ("dependencies", "dependents"):
        out += listed(side, m[side], lambda x: x["module"], lambda x: x["weight"])
    return out + numbers("coupling", {k: m["coupling"][k] for k in ("ca", "ce")})


_REACH = "select 'nodes' as section, row_number() over (order by r.depth, f.path) as position, f.path as key, cast(r.depth as double) as value from reach r join files f on f.id=r.node where r.depth>0 order by r.depth, f.path limit 200"


def _nodes(found: dict) -> list[tuple]:
    return listed("nodes", found["result"]["nodes"], lambda x: x["path"], lambda x: x["depth"]) + total(found)


def _file_30(r: Projected) -> str:
    return r.g.files.where("id = 30").first()["path"]


@query(sql(f"select * from ({_REACH}) union all " + _TOTAL.format("rows", "reach where depth>0", 200), bfs_sql("src", "dst", "id=30", 3)))
def get_dependencies(r: Projected) -> list[tuple]:
    return _nodes(r.get_dependencies(_file_30(r), depth=3, limit=200))


@query(sql(f"select * from ({_REACH}) union all " + _TOTAL.format("rows", "reach where depth>0", 200), bfs_sql("dst", "src", "starts_with(path,'pkg1/m1/')", 2)))
def get_module_dependents(r: Projected) -> list[tuple]:
    """A directory as the target: its files are the start."""
    return _nodes(r.get_dependencies("pkg1/m1/", direction="in", depth=2, limit=200))


_NEAR = """select 'references' as section, row_number() over (order by w.depth, sf.path, w.line, w.id, w.ordinal) as position, sf.path||':'||cast(w.line as varchar)||' '||coalesce(ss.name,'-')||' '||w.kind||' '||w.confidence as key, cast(w.depth as double) as value
 from walk w join files sf on sf.id=w.src_file_id left join symbols ss on ss.id=w.src_symbol_id order by w.depth, sf.path, w.line, w.id, w.ordinal limit 100"""


def _references(rows: list[dict]) -> list[tuple]:
    return listed("references", rows, lambda x: f"{x['path']}:{x['line']} {x['symbolName'] or '-'} {x['via']} {x['confidence']}", lambda x: x["depth"])


@query(sql(f"select * from ({_NEAR}) union all " + _TOTAL.format("rows", "walk", 100), walk_sql("name='sym_8'", "dst_symbol_id", "src_symbol_id", "and confidence in ('heuristic','resolved','exact')", 2)))
def get_symbol_dependents(r: Projected) -> list[tuple]:
    found = r.get_dependencies("sym_8", direction="in", depth=2, min_confidence="heuristic", limit=100)
    return _references(found["result"]["nodes"]) + total(found)


@query(
    sql(
        f"""select * from ({_NEAR}) union all {_TOTAL.format("rows", "walk", 100)}
union all select 'buckets', 0, 'verified', cast(count(*) filter (where confidence='exact') as double) from refs union all select 'buckets', 0, 'likely', count(*) filter (where confidence in ('heuristic','resolved')) from refs
union all select 'buckets', 0, 'ambiguous', count(*) filter (where confidence in ('ambiguous','unresolved')) from refs
union all select 'modules', row_number() over (order by n desc, first), m, n from (select {module("path")} as m, count(*) as n, min(row(depth, path, line, id, ordinal)) as first from refs group by 1)
union all select 'matches', row_number() over (order by f.path, s.start_line), f.path, s.start_line from symbols s join files f on f.id=s.file_id where s.name='sym_8'""",
        IMPACT,
    )
)
def impact_of(r: Projected) -> list[tuple]:
    found = r.impact_of("sym_8", limit=100)
    i = found["result"]
    out = _references(i["references"]) + total(found) + numbers("buckets", i["buckets"])
    return out + listed("modules", i["byModule"], lambda x: x["module"], lambda x: x["count"]) + listed("matches", i["matchedSymbols"], lambda x: x["path"], lambda x: x["line"])


@query(
    sql(
        "select 'nodes' as section, cast(node_id+1 as bigint) as position, name||' '||coalesce(path,'-')||' '||confidence||' '||case when repeated then 'true' else 'false' end as key, cast(coalesce(parent_id+1,0) as double) as value from rec where emitted",
        flow_sql("sym_21", 6, 100),
    )
)
def trace_flow(r: Projected) -> list[tuple]:
    """The tree of a bounded walk, node by node."""
    found = r.trace_flow("sym_21", max_depth=6, limit=100)["result"]
    out: list[tuple] = []

    def lay(node: dict, parent: int) -> None:
        here = len(out) + 1
        out.append(("nodes", here, f"{node['name']} {node['path'] or '-'} {node['confidence']} {str(node['repeated']).lower()}", float(parent)))
        for child in node["calls"]:
            lay(child, here)

    lay(found["root"], 0)
    return out


@query(
    sql(
        f"""select 'cycles' as section, row_number() over (order by size desc, w desc, least) as position, members||' '||cast(size as varchar)||' '||case when real then 'false' else 'true' end as key, cast(w as double) as value from (
 select c.component, string_agg(c.node, ',' order by c.node) as members, count(*) as size, min(c.node) as least, bool_or(c.node in ({FILE_MEMBERS})) as real from comp c group by c.component) g
 join (select x.component, sum(w) as w from me join comp x on x.node=f join comp y on y.node=t where x.component=y.component group by 1) i on i.component=g.component where size>=2 order by size desc, w desc, least limit 50""",
        MODULE_CYCLES,
    )
)
def find_cycles(r: Projected) -> list[tuple]:
    rows = r.find_cycles("module", limit=50)["result"]["cycles"]
    return listed("cycles", rows, lambda x: f"{','.join(x['members'])} {x['size']} {str(x['aggregation_artifact']).lower()}", lambda x: x["internal_edges"])


@query(
    sql(
        "select * from (select 'modules' as section, row_number() over (order by ca+ce desc, module) as position, module||' '||cast(ca as varchar)||' '||cast(ce as varchar) as key, cast(files as double) as value from"
        " (select m.module, coalesce(i.n,0) as ca, coalesce(o.n,0) as ce, m.files from (select module, count(*) as files from fm group by module) m left join (select t, count(*) as n from me group by t) i on i.t=m.module left join (select f, count(*) as n from me group by f) o on o.f=m.module) order by ca+ce desc, module limit 50)"
        " union all select * from (select 'pairs', row_number() over (order by w desc, f, t), f||' '||t, w from me order by w desc, f, t limit 50)"
        " union all " + _TOTAL.format("modules", "(select distinct module from fm)", 50) + " union all " + _TOTAL.format("heaviestPairs", "me", 50)
    )
)
def get_coupling(r: Projected) -> list[tuple]:
    found = r.get_coupling(limit=50)
    c = found["result"]
    out = listed("modules", c["modules"], lambda x: f"{x['module']} {x['ca']} {x['ce']}", lambda x: x["files"]) + listed("pairs", c["heaviestPairs"], lambda x: f"{x['f']} {x['t']}", lambda x: x["w"])
    return out + total(found, "modules") + total(found, "heaviestPairs")


@query(
    sql(
        f"""select * from (select 'hotspots' as section, row_number() over (order by score desc, path) as position, path as key, score as value from ({HOTSPOT_ROWS.replace("commits c on", "wcommits c on")}) order by score desc, path limit 50)
union all select * from (select 'hidden', row_number() over (order by commits desc, a, b), a||' '||b, commits from (
 select least(x.path,y.path) as a, greatest(x.path,y.path) as b, p.commits from (select x.file_id as a, y.file_id as b, count(*) as commits from commit_files x join commit_files y on x.commit_id=y.commit_id and x.file_id<y.file_id
  where x.commit_id in (select commit_id from sizes where n<=50) and x.commit_id in (select commit_id from wcommits) group by 1,2 having count(*)>=3) p join files x on x.id=p.a join files y on y.id=p.b
 where not exists (select 1 from flinks l where (l.src=p.a and l.dst=p.b) or (l.src=p.b and l.dst=p.a)) and not exists (select 1 from flinks u join flinks v on v.src=u.dst where (u.src=p.a and v.dst=p.b) or (u.src=p.b and v.dst=p.a))) order by commits desc, a, b limit 50)
union all select 'history', 0, 'commits', count(*) from wcommits""",
        registry.FILE_CYCLES,
    )
)
def find_hotspots(r: Projected) -> list[tuple]:
    h = r.find_hotspots(limit=50, window_days=730)["result"]
    out = listed("hotspots", h["hotspots"], lambda x: x["path"], lambda x: x["score"]) + listed("hidden", h["hiddenCoupling"], lambda x: f"{x['a']} {x['b']}", lambda x: x["commits"])
    return out + [("history", 0, "commits", float(h["totalCommits"]))]


def _kinds(r: Projected) -> list[tuple]:
    targets = (_file_30(r), "pkg1/m1", "pkg1/", "sym_8", "pkg1/m", "nowhere")
    found = [r.resolve_target(t) for t in targets]
    return [("targets", i + 1, x["kind"], float(len(x.get("candidates", [])))) for i, x in enumerate(found)]


@query(
    sql(
        "select 'targets' as section, cast(n as bigint) as position, kind as key, cast(value as double) as value from (select 1 as n, 'file' as kind, 0 as value union all select 2, 'module', 0 union all select 3, 'module', 0"
        " union all select 4, 'symbol', count(*) from symbols where name='sym_8' union all select 5, 'unknown', 0 union all select 6, 'unknown', 0)"
    )
)
def resolve_target(r: Projected) -> list[tuple]:
    """A file before a directory before a symbol; a part of a directory's name is none."""
    return _kinds(r)


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importers whose resolution differs when every seventh target is gone."""
    g = project(spark, sf_dir)
    names = g.files.select("id", "path")
    stored = g.imports.join(names.toDF("file_id", "path"), "file_id").join(names.toDF("resolved_file_id", "resolved"), "resolved_file_id", "left").select("id", "path", "resolved", "confidence")
    lost = F.col("resolved_file_id") % 7 == 0
    fresh = g.imports.withColumn("confidence", F.when(lost, F.lit("unresolved")).otherwise(F.col("confidence"))).withColumn("resolved_file_id", F.when(~F.coalesce(lost, F.lit(False)), F.col("resolved_file_id")))
    fresh = fresh.join(names.toDF("resolved_file_id", "resolved"), "resolved_file_id", "left").select("id", "resolved", "confidence")
    return incremental.changed_resolutions(stored, fresh)


QUERIES["changed_resolutions"] = _moved
ORACLES["changed_resolutions"] = sql("select distinct f.path from imports i join files f on f.id=i.file_id where i.resolved_file_id%7=0 and i.resolved_file_id in (select id from files)")
QUERIES["unlinked_targets"] = lambda spark, sf_dir: incremental.unlink_targets(registry._edges(project(spark, sf_dir)), project(spark, sf_dir).files.where("lang = 'java'").select("id")).select("id", "ordinal", "dst_file_id", "dst_symbol_id", "confidence")
ORACLES["unlinked_targets"] = sql(
    "select id, ordinal, case when dst_file_id in (select id from files where lang='java') then null else dst_file_id end as dst_file_id, case when dst_file_id in (select id from files where lang='java') then null else dst_symbol_id end as dst_symbol_id, confidence from edges"
)
QUERIES["filtered_text"] = lambda spark, sf_dir: search.text_lines(registry._texts(spark, sf_dir), "LICENSED under", path_prefix="src1", lang="en").select("path", F.col("line").cast("bigint").alias("line"))
ORACLES["filtered_text"] = (
    "select path, line from (select source||'/doc_'||cast(doc_id as varchar)||'.txt' as path, lang, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)),1) as line from documents)"
    " where contains(lower(content),'licensed under') and starts_with(path,'src1') and lang='en'"
)
