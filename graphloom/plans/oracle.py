"""The registered queries as plain SQL over the driver's tables."""

from __future__ import annotations

from .projection import oracle_tables

_MODULE = "case when {p} like '%/%' then regexp_replace({p},'/[^/]*$','') else '.' end"


def module(p: str) -> str:
    return _MODULE.format(p=p)


_BASE = (
    oracle_tables()
    + f""",
links as (select distinct file_id as src, resolved_file_id as dst from imports where resolved_file_id is not null
  and resolved_file_id in (select id from files) and file_id in (select id from files)),
flinks as (select * from links where src<>dst),
fe as (select src, s.path as a, dst, d.path as b from flinks join files s on s.id=src join files d on d.id=dst),
me as (select f, t, count(*) as w from (select {module("a")} as f, {module("b")} as t from fe) where f<>t group by f, t),
fm as (select id, path, lang, {module("path")} as module from files),
targets as (select distinct file_id, resolved_file_id as target from imports where resolved_file_id is not null
  union select distinct i.file_id, sib.id from imports i join fm me1 on me1.id=i.file_id and me1.lang='go'
   join fm r on r.id=i.resolved_file_id and r.lang='go' join fm sib on sib.lang='go' and sib.module=r.module),
localc as (select c.id, s.file_id as dst_file_id, s.id as dst_symbol_id from calls c join symbols s on s.file_id=c.file_id and s.name=c.name),
foreignc as (select * from calls where id not in (select id from localc)),
cand as (select * from localc
  union select c.id, s.file_id, s.id from foreignc c join targets t on t.file_id=c.file_id join symbols s on s.file_id=t.target and s.name=c.name and s.exported
  union select c.id, s.file_id, s.id from foreignc c join fm a on a.id=c.file_id and a.lang in ('go','java')
   join fm b on b.lang=a.lang and b.module=a.module and b.id<>a.id join symbols s on s.file_id=b.id and s.name=c.name),
ranked as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by dst_file_id, dst_symbol_id) as ordinal from cand),
lastsym as (select file_id, name, max(id) as sid from symbols group by file_id, name),
edges as (select c.id, coalesce(r.ordinal,1) as ordinal, c.file_id as src_file_id, l.sid as src_symbol_id, r.dst_file_id, r.dst_symbol_id, c.name as dst_name, c.kind,
  case when r.n is null then 'unresolved' when r.n=1 then 'heuristic' else 'ambiguous' end as confidence, c.line
  from calls c left join ranked r on r.id=c.id left join lastsym l on l.file_id=c.file_id and l.name=c.enclosing),
wcommits as (select * from commits where committed_at >= (select max(committed_at) from commits) - interval 730 day),
sizes as (select commit_id, count(*) as n from commit_files group by commit_id),
pairs as (select x.file_id as a, y.file_id as b, count(*) as commits from commit_files x join commit_files y on x.commit_id=y.commit_id and x.file_id<y.file_id
  where x.commit_id in (select commit_id from sizes where n<=50) and x.commit_id in (select commit_id from commits) group by 1,2 having count(*)>=2)
"""
)


def sql(body: str, recursive: str = "") -> str:
    return f"with recursive {_BASE}{recursive}\n{body}"


def _closure(edges: str, a: str, b: str) -> str:
    return f""",
rc(a,b) as (select {a}, {b} from {edges} union select rc.a, e.{b} from rc join {edges} e on e.{a}=rc.b),
scc as (select x.a as node, min(x.b) as component from rc x join rc y on x.a=y.b and x.b=y.a group by x.a),
comp as (select node, component from scc where component in (select component from scc group by component having count(*)>1))"""


def bfs_sql(a: str, b: str, start: str = "id=30", depth: int = 4) -> str:
    return f""",
rb(node, depth) as (select id, 0 from files where {start} union select l.{b}, rb.depth+1 from rb join flinks l on l.{a}=rb.node where rb.depth<{depth}),
reach as (select node, min(depth) as depth from rb group by node)"""


def walk_sql(start: str, near: str, far: str, extra: str = "", depth: int = 3) -> str:
    return f""",
ue as (select * from edges where 1=1 {extra}),
rw(node, depth) as (select id, 0 from symbols where {start} union select e.{far}, rw.depth+1 from rw join ue e on e.{near}=rw.node where e.{far} is not null and rw.depth<{depth - 1}),
first as (select node, min(depth) as depth from rw group by node),
walk as (select e.*, f.depth+1 as depth from ue e join first f on f.node=e.{near})"""


def flow_sql(name: str, depth: int, limit: int) -> str:
    """The walk of a flow tree, a node or a step back in each round: the stack of open nodes, what was met, what was opened."""
    top = "struct_pack(node:=t.node, module:=t.module, depth:=t.depth, sym:=t.sym, k:=t.k+1)"
    return f""",
adj as materialized (select *, row_number() over (partition by src order by id, ordinal) as k from (select e.src_symbol_id as src, e.id, e.ordinal, e.dst_symbol_id as target, d.path, coalesce(s.name, e.dst_name) as name, e.line, e.confidence
  from edges e left join files d on d.id=e.dst_file_id left join symbols s on s.id=e.dst_symbol_id where e.src_symbol_id is not null)),
start as (select s.id, s.name, f.path, s.start_line as line from symbols s join files f on f.id=s.file_id where s.name='{name}' order by length(s.name), s.name, f.path, s.id limit 1),
rec(stk, seen, opened, n, emitted, node_id, parent_id, ordinal, depth, name, path, line, confidence, crosses_module, repeated) as (
 select [struct_pack(node:=0, module:={module('path')}, depth:=1, sym:=id, k:=cast(1 as bigint))], [id], [id], 1, true, 0, cast(null as int), cast(0 as bigint), 0, name, path, line, 'exact', false, false from start
 union all
 select case when not go then rest when push then list_append(list_append(rest, moved), struct_pack(node:=n, module:=coalesce(m, t.module), depth:=t.depth+1, sym:=target, k:=cast(1 as bigint))) else list_append(rest, moved) end,
  case when go and fresh then list_append(seen, target) else seen end, case when push then list_append(opened, target) else opened end, n+cast(go as int), go,
  n, t.node, t.k-1, t.depth, ename, epath, eline, econf, coalesce(m<>t.module, false), coalesce(list_contains(opened, target), false)
 from (select *, go and fresh and n+1<{limit} and t.depth+1<={depth} as push from (
  select r.*, e.target, e.name as ename, e.path as epath, e.line as eline, e.confidence as econf, case when e.path is not null then {module('e.path')} end as m, {top} as moved, e.src is not null and r.n<{limit} as go, e.target is not null and not list_contains(r.seen, e.target) as fresh
  from (select *, stk[len(stk)] as t, stk[1:len(stk)-1] as rest from rec where len(stk)>0) r left join adj e on e.src=r.t.sym and e.k=r.t.k)))"""


IMPACT = (
    walk_sql("name='sym_8'", "dst_symbol_id", "src_symbol_id")
    + """,
refs as (select path, line, confidence, depth, id, ordinal from (select f.path, w.line, w.confidence, w.depth, w.id, w.ordinal, row_number() over (partition by f.path, w.line order by w.depth, w.id, w.ordinal) as k
  from walk w join files f on f.id=w.src_file_id) where k=1)"""
)

FIX = "regexp_matches(subject, '^(fix|bugfix|hotfix|patch)([(:! ]|$)', 'i')"
_FILE_NAMED = _closure("fe", "a", "b").replace("rc", "frc").replace("scc as", "fscc as").replace("from scc", "from fscc").replace("comp as", "fcomp as")
MODULE_CYCLES = _closure("me", "f", "t") + _FILE_NAMED
FILE_CYCLES = _closure("fe", "a", "b")
#: Modules of files on a cycle of files or that import themselves.
FILE_MEMBERS = f"select {module('path')} from files where path in (select node from fcomp) or id in (select src from links where src=dst)"

HOTSPOT_ROWS = f"""select path, loc, symbols, fan_in, fan_out, in_cycle, commits, bug_fixes,
 floor((cast(0.4 as double)*loc/greatest(1,max(loc) over ()) + cast(0.4 as double)*(fan_in+fan_out)/greatest(1,max(fan_in+fan_out) over ()) + cast(0.2 as double)*in_cycle)
  * (cast(0.6 as double)*commits/greatest(1,max(commits) over ()) + cast(0.4 as double)*bug_fixes/greatest(1,max(bug_fixes) over ()))*10000+cast(0.5 as double))/cast(10000 as double) as score from (
 select f.path, f.loc, (select count(*) from symbols s where s.file_id=f.id) as symbols, (select count(*) from links l where l.dst=f.id) as fan_in,
  (select count(*) from flinks l where l.src=f.id) as fan_out, cast(case when f.path in (select node from comp) then 1 else 0 end as int) as in_cycle, coalesce(h.commits,0) as commits, coalesce(h.fixes,0) as bug_fixes
 from files f left join (select cf.file_id, count(*) as commits, count(*) filter (where {FIX}) as fixes from commit_files cf join commits c on c.commit_id=cf.commit_id group by 1) h on h.file_id=f.id)"""

ORACLES: dict[str, str] = {
    "coupling": sql(
        """select m.module, coalesce(i.ca,0) as ca, coalesce(o.ce,0) as ce,
 case when coalesce(i.ca,0)+coalesce(o.ce,0)=0 then 0.0::double else floor(cast(coalesce(o.ce,0) as double)/(coalesce(i.ca,0)+coalesce(o.ce,0))*10000+cast(0.5 as double))/cast(10000 as double) end as instability, m.files
 from (select module, count(*) as files from fm group by module) m left join (select t, count(*) as ca from me group by t) i on i.t=m.module left join (select f, count(*) as ce from me group by f) o on o.f=m.module"""
    ),
    "file_edges": sql("select a, b from fe"),
    "module_edges": sql("select f, t, w from me"),
    "heaviest_pairs": sql("select f, t, w from me order by w desc, f, t limit 50"),
    "overview_totals": sql(
        "select 'files' as name, count(*) as total from files union all select 'symbols', count(*) from symbols union all select 'imports', count(*) from imports"
        " union all select 'edges', count(*) from edges union all select 'parse_errors', cast(coalesce(sum(error_count),0) as bigint) from files"
    ),
    "language_breakdown": sql("select lang, count(distinct f.id) as files, count(s.id) as symbols from files f left join symbols s on s.file_id=f.id group by lang"),
    "edge_confidence": sql("select t.confidence, count(e.id) as edges from (values ('exact'),('resolved'),('heuristic'),('ambiguous'),('unresolved')) t(confidence) left join edges e on e.confidence=t.confidence group by 1"),
    "internal_target_fraction": sql("select floor(cast(count(*) filter (where confidence<>'unresolved') as double)/count(*)*10000+cast(0.5 as double))/cast(10000 as double) as fraction from edges"),
    "top_modules": sql("select case when path like '%/%' then split_part(path,'/',1) else '.' end as module, count(distinct f.id) as files, count(s.id) as symbols from files f left join symbols s on s.file_id=f.id group by 1"),
    "entry_points": sql(r"select path from files where path='pkg0/blue_widget_1.py' or regexp_matches(path, '0\.ts$') or regexp_extract(path,'[^/]*$') in ('index.ts','main.ts','main.py','main.go','Main.java','main.rs','lib.rs')"),
    "symbol_search_exact": sql("select s.id, s.name, f.path, count(*) over () as total from symbols s join files f on f.id=s.file_id where s.name='sym_8' and not s.exported order by length(s.name), s.name, f.path, s.id limit 50"),
    "symbol_search_partial": sql("select s.id, s.name, f.path, count(*) over () as total from symbols s join files f on f.id=s.file_id where contains(lower(s.name),'ym_1') and s.kind='function' and starts_with(lower(f.path),'pkg1') and f.lang='python' order by length(s.name), s.name, f.path, s.id limit 200"),
    "symbol_callers_callees": sql("select s.id, s.name, coalesce(i.n,0) as caller_count, coalesce(o.n,0) as callee_count from symbols s left join (select dst_symbol_id as id, count(*) as n from edges group by 1) i on i.id=s.id left join (select src_symbol_id as id, count(*) as n from edges group by 1) o on o.id=s.id"),
    "module_surface": sql(f"select {module('f.path')} as module, s.name, s.kind, f.path, s.start_line from symbols s join files f on f.id=s.file_id where s.exported"),
    "module_neighbours": sql("select f as module, 'out' as direction, t as other, w from me union all select t, 'in', f, w from me"),
    "sub_modules": sql("select m.module, count(distinct o.module) as sub_modules, count(*) as additional_files from (select distinct case when module like '%/%' then split_part(module,'/',1) else module end as module from fm) m join fm o on starts_with(o.module, m.module||'/') group by m.module"),
    "call_edges": sql("select * from edges"),
    "edge_details": sql("select e.id, e.ordinal, sf.path as src_path, ss.name as src_name, df.path as dst_path, ds.name as dst_symbol_name, e.dst_name, e.kind, e.confidence, e.line from edges e join files sf on sf.id=e.src_file_id left join symbols ss on ss.id=e.src_symbol_id left join files df on df.id=e.dst_file_id left join symbols ds on ds.id=e.dst_symbol_id"),
    "same_package_pairs": sql("select a.id as src, b.id as dst from fm a join fm b on a.lang=b.lang and a.module=b.module and a.id<>b.id where a.lang in ('go','java')"),
    "import_targets": sql("select file_id, target from targets"),
    "deps_out": sql("select f.path, cast(r.depth as int) as depth from reach r join files f on f.id=r.node where r.depth>0", bfs_sql("src", "dst")),
    "deps_in": sql("select f.path, cast(r.depth as int) as depth from reach r join files f on f.id=r.node where r.depth>0", bfs_sql("dst", "src")),
    "symbol_walk": sql("select id, ordinal, dst_name, confidence, cast(depth as int) as depth from walk", walk_sql("name='sym_8'", "src_symbol_id", "dst_symbol_id")),
    "symbol_walk_filtered": sql("select id, ordinal, dst_name, confidence, cast(depth as int) as depth from walk", walk_sql("name='sym_8'", "src_symbol_id", "dst_symbol_id", "and kind='calls' and confidence in ('heuristic','resolved','exact')")),
    "flow_tree": sql("select node_id, parent_id, cast(ordinal as int) as ordinal, depth, name, path, line, confidence, crosses_module, repeated from rec where emitted", flow_sql("sym_21", 6, 100)),
    "impact_buckets": sql("select count(*) as total, count(*) filter (where confidence='exact') as verified, count(*) filter (where confidence in ('heuristic','resolved')) as likely, count(*) filter (where confidence in ('ambiguous','unresolved')) as ambiguous from refs", IMPACT),
    "impact_by_module": sql(f"select {module('path')} as module, count(*) as count from refs group by 1", IMPACT),
    "file_cycles": sql("select string_agg(node, ',' order by node) as members, count(*) as size, max(w) as internal_edges from comp join (select x.component as k, count(*) as w from fe join comp x on x.node=a join comp y on y.node=b where x.component=y.component group by 1) on k=component group by component", FILE_CYCLES),
    "module_cycles": sql("select string_agg(node, ',' order by node) as members, count(*) as size, max(w) as internal_edges from comp join (select x.component as k, cast(sum(w) as bigint) as w from me join comp x on x.node=f join comp y on y.node=t where x.component=y.component group by 1) on k=component group by component", MODULE_CYCLES),
    "cycle_hops": sql(f"select f, t, n_pairs, via_from, via_to from (select p.f, p.t, count(*) over (partition by p.f, p.t) as n_pairs, row_number() over (partition by p.f, p.t order by a, b) as k, a as via_from, b as via_to from (select a, b, {module('a')} as f, {module('b')} as t from fe) p join comp x on x.node=p.f join comp y on y.node=p.t where x.component=y.component and p.f<>p.t) where k<=3", MODULE_CYCLES),
    "cycle_artifact": sql(f"select m.component, not bool_or(m.node in ({FILE_MEMBERS})) as aggregation_artifact from comp m group by m.component", MODULE_CYCLES),
    "churn": sql(f"select cf.file_id, count(*) as commits, count(distinct author) as authors, count(*) filter (where {FIX}) as bug_fixes, arg_max(committed_at, (committed_at, c.commit_id)) as last_commit_at from commit_files cf join wcommits c on c.commit_id=cf.commit_id group by cf.file_id"),
    "bug_fix_commits": sql(f"select commit_id, subject from commits where {FIX}"),
    "commit_totals": sql("select count(*) as total_commits, count(*) filter (where n>6) as skipped_large_commits from commits c left join sizes s on s.commit_id=c.commit_id"),
    "co_change": sql("select a, b, commits from pairs"),
    "hidden_coupling": sql("select a, b, commits from pairs p where not exists (select 1 from flinks l where (l.src=p.a and l.dst=p.b) or (l.src=p.b and l.dst=p.a)) and not exists (select 1 from flinks x join flinks y on y.src=x.dst where (x.src=p.a and y.dst=p.b) or (x.src=p.b and y.dst=p.a))"),
    "hotspots": sql(HOTSPOT_ROWS, FILE_CYCLES),
    "text_search": "select path, line, left(regexp_replace(content,'^\\s+|\\s+$','','g'),200) as snippet from (select source||'/doc_'||cast(doc_id as varchar)||'.txt' as path, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)),1) as line from documents) where contains(lower(content),'licensed under')",
    "code_search": sql(
        """select path, line, kind, symbol_name, snippet, score, count(*) over () as total from (
 select *, row_number() over (partition by path, line order by score desc, len, symbol_name, id) as k from (
 select f.path, cast(s.start_line as bigint) as line, 'symbol' as kind, s.name as symbol_name, left(coalesce(s.signature,s.name),200) as snippet, cast(case when s.name='sym_1' then 100 else 60 end as bigint) as score, length(s.name) as len, s.id
  from symbols s join files f on f.id=s.file_id where contains(lower(s.name),'sym_1')
 union all select path, line, 'text', null, left(regexp_replace(content,'^\\s+|\\s+$','','g'),200), 20, 0, 0 from (select source||'/doc_'||cast(doc_id as varchar)||'.txt' as path, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)),1) as line from documents) where contains(lower(content),'sym_1'))) where k=1 order by score desc, path, line limit 500"""
    ),
}

_NEXT = "from files f join files t on t.id=f.id+6"
_STEM = "regexp_replace(regexp_extract(t.path,'[^/]*$'),'[.]ts$','')"
_DIR = "case when {p} like '%/%' then regexp_replace({p},'/[^/]*$','') else '' end"
_F, _T = _DIR.format(p="f.path"), _DIR.format(p="t.path")
_PARENT = _DIR.format(p="(" + _F + ")")

ORACLES |= {
    "resolve_javascript": sql(
        f"""select x.id, x.specifier, k.path as resolved, case when k.path is null then 'unresolved' else 'resolved' end as confidence from (
 select f.id, case when f.id%12=0 then './'||{_STEM} when f.id%4=0 then 'lodash' when f.id%4=2 then '../'||regexp_extract({_T},'[^/]*$')||'/'||{_STEM}||'.js' else './'||{_STEM} end as specifier,
  case when f.id%12=0 then {_F}||'/'||{_STEM} when f.id%4=0 then null when f.id%4=2 then case when {_PARENT}='' then '' else {_PARENT}||'/' end||regexp_extract({_T},'[^/]*$')||'/'||{_STEM} else {_F}||'/'||{_STEM} end||'.ts' as candidate
 {_NEXT} where f.lang='typescript') x left join files k on k.path=x.candidate"""
    ),
    "resolve_python": sql(f"select f.id, case when f.id%5=0 then 'os.path' else replace(regexp_replace(t.path,'[.]py$',''),'/','.')||case when f.id%2=0 then '' else '.Item' end end as specifier, case when f.id%5=0 then null else t.path end as resolved, case when f.id%5=0 then 'unresolved' else 'resolved' end as confidence {_NEXT} where f.lang='python'"),
    "resolve_java": sql(f"select f.id, replace(regexp_replace(regexp_replace(t.path,'^[^/]*/',''),'[.]java$',''),'/','.')||case when f.id%5=0 then '.*' else '' end as specifier, case when f.id%5=0 then null else t.path end as resolved, case when f.id%5=0 then 'unresolved' else 'resolved' end as confidence {_NEXT} where f.lang='java'"),
    "resolve_rust": sql(
        f"""select id, specifier, case when inside then path end as resolved, case when inside then 'resolved' else 'unresolved' end as confidence from (
 select f.id, t.path, f.id%5>1 and {_F}={_T} as inside, case f.id%5 when 0 then 'std::fmt::Debug' when 1 then 'crate::a::b' else 'super::'||regexp_replace(regexp_extract(t.path,'[^/]*$'),'[.]rs$','')||case f.id%5 when 3 then '::*' when 4 then '::Item' else '' end end as specifier
 {_NEXT} where f.lang='rust')"""
    ),
    "resolve_go": sql(f"select f.id, case when f.id%5=0 then 'fmt' else 'example.com/m/'||{_T} end as specifier, case when f.id%5=0 then null else (select min(g.path) from fm g where g.lang='go' and g.module={_T}) end as resolved, case when f.id%5=0 then 'unresolved' else 'resolved' end as confidence {_NEXT} where f.lang='go'"),
}

_STATES = """,
nowf as (select path, case when id%19=0 then null else sha256(path||case when id%13=0 then '!' else '' end) end as h from files where id%17<>0),
oldf as (select path, sha256(path) as h from files where id%11<>0),
delta as (select coalesce(n.path,o.path) as path, case when n.path is null then 'deleted' when o.path is not null and n.h=o.h then 'unchanged' else 'changed' end as status from nowf n full outer join oldf o on n.path=o.path)"""
_AS_FILES = """with d as (select case when doc_id%9=0 then 'vendor/' else 'lib/' end||source||'/f'||cast(doc_id as varchar)||case when doc_id%7=0 then '.min.js' when doc_id%3=0 then '.py' else '.txt' end as path, text from documents)"""

ORACLES |= {
    "changeset": sql("select path, status from delta", _STATES),
    "dilation": sql(
        """select path from (
 select path from touched union select s.path from links l join files s on s.id=l.src join files r on r.id=l.dst where r.path in (select path from touched)
 union select path from fm where lang in ('go','java') and (lang, module) in (select lang, module from fm where path in (select path from touched))
 union select s.path from links l join fm s on s.id=l.src and s.lang='go' join fm r on r.id=l.dst where r.module in (select module from fm where lang='go' and path in (select path from touched))
) where path not in (select path from delta where status='deleted')""",
        _STATES + ",\ntouched as (select path from delta where status<>'unchanged')",
    ),
    "skip_breakdown": _AS_FILES + " select case when path like 'vendor/%' then 'vendored' when strlen(text)*50>1000000 then 'too-large' when path like '%.min.js' then 'minified' when path like '%.py' and length(text)/greatest(1,len(string_split(text,chr(10))))>500 then 'minified' else 'indexed' end as reason, count(*) as files from d group by 1",
    "file_metrics": _AS_FILES + " select path, case when path like '%.min.js' then '.js' when path like '%.py' then '.py' else '.txt' end as extension, case when path like '%.min.js' then 'javascript' when path like '%.py' then 'python' end as lang, case when text='' then 0 else len(string_split(text,chr(10)))-cast(ends_with(text,chr(10)) as int) end as loc, sha256(text) as content_hash from d",
    "path_functions": sql(f"select f.path, case when {_PARENT}='' then '' else {_PARENT}||'/' end||'x/'||regexp_extract(f.path,'[^/]*$') as folded, cast(case when f.path like 'pkg1/m1/%' then 2 when f.path like 'pkg1/%' then 1 else 0 end as bigint) as shared from files f"),
    "manifest_values": "select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events",
    "truncation_totals": sql("select id, name, count(*) over () as total from symbols where exported order by id limit 25"),
    "streaming_churn": "select date_trunc('hour', ts) as start, event_type, count(*) as events, count(distinct user_id) as users from events group by 1,2",
    "windowed_churn": "select date_trunc('hour', ts) as start, event_type, count(*) as events, count(distinct user_id) as users from events group by 1,2",
}
