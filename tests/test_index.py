"""Indexes of a real checkout: cold build, refresh, freshness, queries."""

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom import api, cli
from graphloom.plans import index
from graphloom.sources import repository

SOURCES = {
    "src/helper.ts": "export function helper() { return 1 }\nexport function unused() {}\n",
    "src/services/notify.ts": "export function notify(x) { return x }\n",
    "src/services/order.ts": "import { notify } from './notify'\nimport { helper } from '../helper'\nexport class OrderService {\n  place() {\n    notify(1)\n    return helper()\n  }\n}\n",
    "src/index.ts": "import { OrderService } from './services/order'\nimport fs from 'node:fs'\nexport function main() { return new OrderService().place() }\n",
    "pkg/__init__.py": "from .helper import helper\n\ndef setup():\n    return helper()\n",
    "pkg/_private.py": "def hidden():\n    return 2\n",
    "pkg/empty.py": "",
    ".config/tool.py": "def configured():\n    return 3\n",
    "pkg/helper.py": "def helper():\n    return 1\n",
    "pkg/service.py": "from .helper import helper\n\ndef serve():\n    return helper()\n",
    "go.mod": "module example.com/m\n",
    "one/a.go": "package one\nfunc Do() { low() }\n",
    "one/b.go": "package one\nfunc low() {}\n",
    "main.go": 'package main\nimport "example.com/m/one"\nfunc main() { one.Do() }\n',
    "package.json": '{"main": "./src/index.ts", "bin": {"x": "src\\\\cli.ts"}}',
    "README.md": "# notes on notify\n",
    "bundle.min.js": "var a=1\n",
    "assets/logo.bin": "a\x00b",
    "node_modules/p/index.js": "x\n",
}


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def commit(root, message):
    for args in (["add", "-A", "-f"], ["-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True)


@pytest.fixture()
def checkout(tmp_path):
    root = tmp_path / "repo"
    write(root, SOURCES)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    commit(root, "feat: start")
    return root


def picture(spark, home):
    """The index without identifiers."""
    s = index.load(spark, home)
    f = s.files.select("id", "path")
    out = {("F", r["path"], r["lang"], r["content_hash"], r["error_count"]) for r in s.files.collect()}
    out |= {("S", r["path"], r["name"], r["kind"], r["start_line"], r["end_line"], r["exported"]) for r in s.symbols.join(f.toDF("file_id", "path"), "file_id").collect()}
    out |= {("I", r["path"], r["specifier"], r["resolved"], r["confidence"]) for r in s.imports.collect()}
    from graphloom.operators.calls import edge_details

    out |= {("E", *(r[c] for c in ("src_path", "src_name", "dst_path", "dst_symbol_name", "dst_name", "kind", "confidence", "line"))) for r in edge_details(s.edges.drop("src_path"), s.files, s.symbols).collect()}
    return out


def test_discovery_skips_and_counts(spark, checkout):
    found = repository.discover(spark, str(checkout))
    reasons = {r["path"]: r["skip_reason"] for r in found.collect() if r["skip_reason"]}
    assert reasons == {"bundle.min.js": "minified", "assets/logo.bin": "binary", "node_modules/p/index.js": "vendored"}
    subprocess.run(["rm", "-rf", str(checkout / ".git")], check=True)
    walked = {r["path"]: r["skip_reason"] for r in repository.discover(spark, str(checkout)).collect() if r["skip_reason"]}
    assert walked == {"bundle.min.js": "minified", "assets/logo.bin": "binary", "node_modules/<directory>": "vendored"}


def test_hidden_names_are_read_and_edits_to_them_noticed(spark, first_build, tmp_path):
    at = index.load(spark, f"file://{first_build}/home")
    named = {(r["path"], r["name"]) for r in at.symbols.join(at.files.select(F.col("id").alias("file_id"), "path"), "file_id").collect()}
    assert {("pkg/__init__.py", "setup"), ("pkg/_private.py", "hidden"), (".config/tool.py", "configured")} <= named
    checkout = tmp_path / "repo"
    shutil.copytree(first_build / "repo", checkout)
    write(checkout, {"pkg/__init__.py": "def setup():\n    return 0\n"})
    assert [r["path"] for r in index.changes(spark, at, repository.discover(spark, str(checkout))).where("status = 'changed'").collect()] == ["pkg/__init__.py"]


def test_what_cannot_be_read_is_not_empty(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1\n", "b.py": ""})
    listed = spark.createDataFrame([("a.py", 6, True, True), ("gone.py", 5, True, True), ("b.py", 0, True, True), ("vendor/x.py", 3, True, True)], "path string, size bigint, readable boolean, is_file boolean")
    got = {r["path"]: (r["content"], r["readable"]) for r in repository.read_contents(listed, str(tmp_path)).collect()}
    assert got == {"a.py": (b"x = 1\n", True), "gone.py": (None, False), "b.py": (b"", True), "vendor/x.py": (None, True)}


def test_a_crash_leaves_an_index(spark, checkout, tmp_path):
    home = f"file://{tmp_path}/home"
    report = index.build(spark, str(checkout), home)
    assert report["symbols"] > 10 and report["edges"] > 3 and report["files_skipped"] == 3 and report["duration_ms"] > 0
    (tmp_path / "home" / "meta").rename(tmp_path / "home" / "meta-next")
    assert index.load(spark, home).meta["index_complete"] == "true"
    write(checkout, {"src/helper.ts": "// edited\n"})
    assert index.refresh(spark, str(checkout), home)["changed"] == 1
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "home").iterdir()) == ["meta", "snapshot", "snapshot"]
    for p in (tmp_path / "home").glob("snapshot-*/files/*.parquet"):
        p.write_bytes(b"junk")
    for p in (tmp_path / "home").glob("snapshot-*/files/.*.crc"):
        p.unlink()
    with pytest.raises(index.IndexError_, match="corrupt"):
        index.load(spark, home).files.count()


@pytest.fixture(scope="module")
def first_build(spark, tmp_path_factory):
    """One cold build of the unedited sources; tests copy its checkout and its meta table."""
    top = tmp_path_factory.mktemp("first")
    write(top / "repo", SOURCES)
    subprocess.run(["git", "init", "-q", str(top / "repo")], check=True)
    commit(top / "repo", "feat: start")
    index.build(spark, str(top / "repo"), f"file://{top}/home")
    return top


@pytest.mark.parametrize(
    "edits",
    [
        {"src/helper.ts": "export function renamed() { return 1 }\n", "README.md": "edited\n"},
        {"src/services/notify.ts": None, "pkg/helper/__init__.py": "def helper():\n    return 3\n", "src/extra.ts": "import { helper } from './helper'\nhelper()\n"},
        {"one/c.go": "package one\nfunc low2() {}\n", "one/b.go": "package one\n", "src/services/notify/index.ts": "export const x = 1\n"},
    ],
)
def test_refresh_equals_rebuild(spark, first_build, tmp_path, edits):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    checkout = tmp_path / "repo"
    shutil.copytree(first_build / "repo", checkout)
    shutil.copytree(first_build / "home" / "meta", tmp_path / "a" / "meta")
    for name, text in edits.items():
        if text is None:
            (checkout / name).unlink()
        else:
            write(checkout, {name: text})
    done = index.refresh(spark, str(checkout), a)
    assert done["fell_back_to_cold"] == 0 and done["changed"] + done["deleted"] > 0
    index.build(spark, str(checkout), b)
    assert picture(spark, a) == picture(spark, b)


def test_freshness_and_commit_protocol(spark, checkout, tmp_path):
    home = f"file://{tmp_path}/home"
    assert index.freshness(spark, str(checkout), home) == ("missing", 0)
    index.build(spark, str(checkout), home)
    assert index.freshness(spark, str(checkout), home) == ("current", 0)
    assert index.refresh(spark, str(checkout), home)["changed"] == 0
    write(checkout, {"src/helper.ts": "// edited\n"})
    assert index.freshness(spark, str(checkout), home) == ("stale", 1)
    assert index.ensure_fresh(spark, str(checkout), home) == ("current", 0)
    index._remove(spark, f"{home}/meta")
    assert index.freshness(spark, str(checkout), home)[0] == "incomplete"
    with pytest.raises(index.IndexError_):
        index.load(spark, home)


def test_public_queries(spark, checkout, tmp_path):
    write(checkout, {"src/helper.ts": SOURCES["src/helper.ts"] + "// more\n"})
    commit(checkout, "fix: helper")
    repo = api.Repository(spark, str(checkout), f"file://{tmp_path}/home")
    o = repo.get_repo_overview()
    assert o["index"]["state"] == "current" and o["result"]["skipped"] == {"minified": 1, "binary": 1, "vendored": 1}
    assert "src/index.ts" in o["result"]["entryPoints"] and "main.go" in o["result"]["entryPoints"]
    hits = repo.search_code("notify")["result"]["hits"]
    assert hits[0]["score"] == 100 and hits[0]["path"] == "src/services/notify.ts" and any(h["path"] == "README.md" for h in hits)
    assert repo.get_symbol("helper")["result"]["totalMatches"] == 2
    m = repo.describe_module("src/services")["result"]
    assert m["files"] == ["src/services/notify.ts", "src/services/order.ts"] and [d["module"] for d in m["dependencies"]] == ["src"]
    d = repo.get_dependencies("src/index.ts", depth=2)["result"]
    assert [(n["path"], n["depth"]) for n in d["nodes"]] == [("src/services/order.ts", 1), ("src/helper.ts", 2), ("src/services/notify.ts", 2)]
    assert repo.get_dependencies("nowhere")["result"]["target"]["kind"] == "unknown"
    assert repo.get_dependencies("notify", direction="in")["result"]["nodes"][0]["symbolName"] == "place"
    i = repo.impact_of("place")["result"]
    assert i["totalReferences"] == 1 and i["buckets"]["likely"] == 1 and not i["exportedFromEntryPoint"]
    t = repo.trace_flow("main", file="src")["result"]
    assert t["root"]["name"] == "main" and [c["name"] for c in t["root"]["calls"]] == ["OrderService", "place"]
    assert repo.find_cycles("module")["result"]["cycles"][0]["members"] == ["src", "src/services"]
    assert repo.find_cycles("module")["result"]["cycles"][0]["aggregation_artifact"] is True
    assert repo.find_cycles("file")["result"]["totalCycles"] == 0
    c = repo.get_coupling(limit=1)
    assert c["truncated"]["modules"]["returned"] == 1 and c["truncated"]["modules"]["total"] > 1
    h = repo.find_hotspots(limit=500)["result"]
    assert h["gitAvailable"] and h["totalCommits"] == 2 and h["hotspots"][0]["score"] > 0
    json.loads(api.to_json(o))
    for bad in (lambda: repo.get_coupling(limit=0), lambda: repo.get_dependencies("x", depth=11), lambda: repo.find_cycles("galaxy")):
        with pytest.raises(ValueError):
            bad()


def test_serving_survives_bad_requests(spark, tmp_path):
    answers = []
    lines = ["{broken", "[1]", "", json.dumps({"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "find_cycles", "arguments": {"repo": str(tmp_path), "colour": 1}}}), json.dumps({"jsonrpc": "2.0", "id": 5, "method": "tools/list"})]
    cli.serve(spark, f"file://{tmp_path}/h", lines, lambda text: answers.append(json.loads(text)))
    assert [a.get("error", {}).get("code") for a in answers] == [-32700, -32700, -32602, None]
    tools = {t["name"]: t for t in answers[-1]["result"]["tools"]}
    assert tools["get_dependencies"]["inputSchema"]["required"] == ["target"] and tools["get_dependencies"]["inputSchema"]["properties"]["minConfidence"]["enum"][0] == "exact"
    assert tools["find_hotspots"]["inputSchema"]["properties"]["windowDays"] == {"type": "integer", "minimum": 1, "maximum": 3650, "default": 180}
    assert all(t["description"] for t in tools.values())


def test_json_rpc(spark, tmp_path):
    ask = lambda **r: cli.respond(spark, f"file://{tmp_path}", {"jsonrpc": "2.0", "id": 1, **r})
    assert len(ask(method="tools/list")["result"]["tools"]) == 10
    assert ask(method="nope")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "nope"})["error"]["code"] == -32602
    assert cli.respond(spark, "x", {"method": "notifications/initialized"}) is None


def test_git_log_and_manifests(spark, checkout):
    log = repository.git_log(spark, str(checkout), 30).collect()
    assert {r["subject"] for r in log} == {"feat: start"} and len(log) == len(SOURCES)
    assert repository.git_log(spark, str(checkout), 0).isEmpty()
    texts = spark.createDataFrame([(SOURCES["package.json"],), ("{broken",), ('{"exports": {".": "./a.js"}}',)], "text string")
    assert {r["path"] for r in repository.manifest_entry_points(texts).collect()} == {"src/index.ts", "src/cli.ts", "a.js"}
    assert repository.go_module_prefix(spark.createDataFrame([("// x\nmodule example.com/m\n",)], "text string")) == "example.com/m"
    assert repository.head_commit("/") is None
