"""The graph tables as projections of the driver's star schema.

One SQL text per table, with table names as ``{placeholders}``: Spark fills in
DataFrames, the oracle plain names.  Identifiers are numbered within a file,
so that no projection needs one partition for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .stored import stored

_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_PKG = "'pkg'||cast(cast(floor(p_partkey/100) as bigint) as string)"

FILES = f"""
select p_partkey as id,
 case when p_partkey%100<20 then {_PKG} else {_PKG}||'/m'||cast(cast(floor((p_partkey%100)/20) as bigint) as string) end
 ||'/'||replace(p_name,' ','_')||'_'||cast(p_partkey as string)
 ||(case p_partkey%6 when 0 then '.ts' when 1 then '.py' when 2 then '.go' when 3 then '.java' when 4 then '.rs' else '.md' end) as path,
 case p_partkey%6 when 0 then 'typescript' when 1 then 'python' when 2 then 'go' when 3 then 'java' when 4 then 'rust' end as lang,
 cast(p_size*10 as int) as loc, cast(case when p_partkey%97=0 then 1 else 0 end as int) as error_count
from {{part}}"""

# Every line item is an import and a call site.  Most imports are of packages outside the repository, as in real ones.
IMPORTS = f"""
select l_partkey*100000 + row_number() over (partition by l_partkey order by {_ORDER}) as id, l_partkey as file_id,
 case when l_linestatus='O' or l_discount>0.03 or l_quantity>=13 then null
      when l_linenumber=1 then (l_partkey+n-1-(l_suppkey%40))%n
      else (l_partkey+1+(l_suppkey%60))%n end as resolved_file_id,
 case when l_linestatus='O' or l_discount>0.03 or l_quantity>=13 then 'unresolved' else 'resolved' end as confidence, cast(l_linenumber as int) as line
from {{lineitem}} cross join (select count(*) as n from {{part}})"""

SYMBOLS = """
select p_partkey*10+k as id, p_partkey as file_id, 'sym_'||cast((p_partkey*5+k*3)%40 as string) as name,
 case k when 0 then 'function' when 1 then 'class' when 2 then 'method' else 'interface' end as kind,
 cast((k+1)*10 as int) as start_line, cast((k+1)*10+5 as int) as end_line, k%2=0 as exported,
 case when k=3 then null else 'def sym_'||cast((p_partkey*5+k*3)%40 as string)||'()' end as signature
from {part} cross join (values (0),(1),(2),(3)) as ks(k) where k<=p_size%4"""

CALLS = f"""
select l_partkey*100000 + row_number() over (partition by l_partkey order by {_ORDER}) as id, l_partkey as file_id,
 'sym_'||cast((l_partkey*5+l_suppkey*3+l_linenumber)%48 as string) as name,
 'sym_'||cast((l_partkey*5+(l_linenumber%3)*3)%40 as string) as enclosing,
 case when l_linenumber%5=0 then 'instantiates' else 'calls' end as kind, cast(l_linenumber as int) as line
from {{lineitem}}"""

COMMITS = """
select o_orderkey as commit_id, o_custkey as author, o_orderdate as committed_at,
 case o_orderpriority when '1-URGENT' then 'fix: urgent' when '2-HIGH' then 'Hotfix(core) now' when '3-MEDIUM' then 'feat: more'
   when '4-NOT SPECIFIED' then 'fixes a typo' else 'docs' end as subject
from {orders}"""

COMMIT_FILES = "select distinct l_orderkey as commit_id, l_partkey as file_id from {lineitem}"

TABLES = {"files": FILES, "imports": IMPORTS, "symbols": SYMBOLS, "calls": CALLS, "commits": COMMITS, "commit_files": COMMIT_FILES}
SOURCES = ("part", "lineitem", "orders")


@dataclass
class Graph:
    """The relational form of a repository.

    files(id, path, lang, loc, error_count), symbols(id, file_id, name, kind,
    start_line, end_line, exported, signature), imports(id, file_id,
    resolved_file_id, confidence, line), calls(id, file_id, name, enclosing,
    kind, line), commits(commit_id, author, committed_at, subject) and
    commit_files(commit_id, file_id).
    """

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    folder: str


#: Tables whose numbering needs a shuffle; they are written once (see ``stored``).
NUMBERED = ("imports", "calls")


def project(spark: SparkSession, sf_dir: str) -> Graph:
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}

    def table(name: str) -> DataFrame:
        text = TABLES[name]
        return spark.sql(text, **{t: df for t, df in sources.items() if "{" + t + "}" in text})

    return Graph(**{name: stored(spark, sf_dir, name, lambda name=name: table(name)) if name in NUMBERED else table(name) for name in TABLES}, folder=sf_dir)


def oracle_tables() -> str:
    """The same projections as the common table expressions of a plain SQL query."""
    named = {t: t for t in SOURCES}
    return ",\n".join(f"{name} as ({text.format(**named)})" for name, text in TABLES.items())
