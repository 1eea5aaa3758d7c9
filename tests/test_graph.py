"""Graph operators against small hand-made graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import calls, components, flow, history, impact, search, structure


@pytest.fixture(scope="module")
def small(spark):
    files = spark.createDataFrame([(1, "app/a.ts", "typescript"), (2, "app/b.ts", "typescript"), (3, "core/c.ts", "typescript"), (4, "util/u.ts", "typescript"), (5, "lone.md", None)], "id bigint, path string, lang string")
    imports = spark.createDataFrame([(1, 1, 3), (2, 2, 3), (3, 1, 4), (4, 3, 4), (5, 1, 3), (6, 1, None), (7, 4, 4)], "id bigint, file_id bigint, resolved_file_id bigint")
    return files, imports


def test_coupling_counts_distinct_modules(small):
    files, imports = small
    edges = structure.file_edges(imports, files)
    got = {r["module"]: (r["ca"], r["ce"], r["instability"], r["files"]) for r in structure.coupling(files, structure.module_edges(edges)).collect()}
    assert got == {"app": (0, 2, 1.0, 2), "core": (1, 1, 0.5, 1), "util": (2, 0, 0.0, 1), ".": (0, 0, 0.0, 1)}


def test_module_edge_weight_counts_distinct_file_pairs(small):
    files, imports = small
    got = {(r["f"], r["t"]): r["w"] for r in structure.module_edges(structure.file_edges(imports, files)).collect()}
    assert got == {("app", "core"): 2, ("app", "util"): 1, ("core", "util"): 1}


def test_self_imports_only_on_request(small):
    files, imports = small
    assert structure.file_links(imports, files).where("src = dst").isEmpty()
    assert structure.file_links(imports, files, self_links=True).where("src = dst").count() == 1


def test_bfs_reports_first_depth_and_limit(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    start = spark.createDataFrame([(1,)], "node bigint")
    found, limited = structure.bfs(links, start, 1)
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(2, 1), (3, 1)} and limited
    found, limited = structure.bfs(links, start, 9)
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(2, 1), (3, 1), (4, 2)} and not limited
    found, _ = structure.bfs(links, spark.createDataFrame([(4,)], "node bigint"), 2, "in")
    assert {(r["node"], r["depth"]) for r in found.collect()} == {(3, 1), (1, 2), (2, 2)}


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    out = {a: {b for x, b in edges if x == a} for a in nodes}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    r = {a: reach(a) for a in nodes}
    groups = {a: min({a} | {b for b in r[a] if a in r[b]}) for a in nodes}
    sizes = {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    return {a: g for a, g in groups.items() if sizes[g] > 1}


@pytest.mark.parametrize("seed,one_task", [(1, 10**6), (2, 10**6), (3, 0)])
def test_strong_components_match_brute_force(spark, seed, one_task):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    edges = sorted((a, b) for a, b in edges if a != b)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in components.strong_components(df, one_task_edges=one_task).collect()}
    assert got == brute_components(edges)


@pytest.mark.parametrize("closed", [False, True])
def test_long_paths_are_shortened(spark, closed):
    n = 20_000
    edges = [(i, i + 1) for i in range(n)] + [(n, 0)] * closed
    got = {r["node"]: r["component"] for r in components.strong_components(spark.createDataFrame(edges, "src bigint, dst bigint"), one_task_edges=0).collect()}
    assert got == ({i: 0 for i in range(n + 1)} if closed else {})


def test_paths_between_cycles_join_them_only_both_ways(spark):
    """Paths that hang on a node, on two nodes of one component, or lead from one component to another."""
    core = [(0, 1), (1, 2), (2, 0), (1, 0), (2, 1), (0, 2)]
    edges = [*core, (0, 10), (10, 11), (11, 12), (12, 2), (1, 20), (20, 21), (21, 1), (2, 30), (30, 31), (31, 40), (40, 41), (41, 40), (50, 51), (51, 52), (52, 50)]
    want = components.tarjan(edges)
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    got = {r["node"]: r["component"] for r in components.strong_components(spark.createDataFrame(edges, "src bigint, dst bigint"), one_task_edges=0).collect()}
    assert got == {k: c for k, c in want.items() if sizes[c] > 1}


def _ring(n):
    """Modules that import the next two and the one before: one cycle of a diameter of n / 3."""
    return [(f"pkg{i:05d}", f"pkg{(i + step) % n:05d}") for i in range(n) for step in (1, 2, -1)]


@pytest.mark.parametrize("blocks", [True, False])
def test_wide_rings_need_no_rounds_along_them(spark, monkeypatch, blocks):
    """By blocks of edges, and by pairs that link both ways where the blocks find nothing."""

    def never(*_):
        raise AssertionError("rounds as many as the diameter")

    monkeypatch.setattr(components, "_by_colouring", never)
    if not blocks:
        monkeypatch.setattr(components, "_within_blocks", lambda edges, kind, n: spark.createDataFrame([], f"node {kind}, least {kind}"))
    n = 600
    df = spark.createDataFrame([*_ring(n), ("a", "pkg00000"), ("pkg00000", "z")], "src string, dst string")
    got = {r["node"]: r["component"] for r in components.strong_components(df, one_task_edges=300).collect()}
    assert got == {f"pkg{i:05d}": "pkg00000" for i in range(n)}


@pytest.mark.parametrize("seed", [5, 6])
def test_contracted_components_match_one_task(spark, seed):
    """Dense and sparse parts, with a node whose edges lie in several blocks."""
    rng = random.Random(seed)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(420)} | {(7, rng.randrange(300)) for _ in range(150)}
    edges |= {(a, a + rng.choice((1, 2, -1))) for a in range(310, 400) for _ in range(2)}
    edges = sorted((a, b) for a, b in edges if a != b)
    want = components.tarjan(edges)
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = components.contract(df, "bigint", 8, len(edges))
    assert found is not None and all(want[r["node"]] == want[r["least"]] for r in found[1].collect())
    got = {r["node"]: r["component"] for r in components.strong_components(df, one_task_edges=100).collect()}
    assert got == {k: c for k, c in want.items() if sizes[c] > 1}


def test_finding_cycles_resolves_no_calls(spark, monkeypatch):
    from graphloom import registry, registry_api

    def never(_):
        raise AssertionError("calls resolved")

    monkeypatch.setattr(registry, "_edges", never)
    rows = registry_api.QUERIES["find_cycles"](spark, "/root/testdata/sf0.001").collect()
    assert [r["section"] for r in rows][:1] == ["cycles"]


def test_wide_walks_agree_with_narrow_ones(spark):
    import random

    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(110)], "src bigint, dst bigint")
    start = spark.createDataFrame([(1,), (2,), (3,)], "node bigint")
    want = None
    for small in (10_000, 4, 1, 0):
        found, limited = structure.bfs(links, start, 4, small=small)
        got = (sorted((r["node"], r["depth"]) for r in found.collect()), limited)
        want = want or got
        assert got == want and len(got[0]) > 10


def test_history_takes_the_first_record_of_the_log(spark):
    commits = spark.createDataFrame([("a", 0, "x", "2024-01-01T23:30:00-05:00", "fix: it"), ("b", 1, "y", "2024-01-02T01:00:00+09:00", "more")], "commit_id string, log_ordinal bigint, author string, committed_at string, subject string")
    files = spark.createDataFrame([("a", 1), ("b", 1)], "commit_id string, file_id bigint")
    assert history.churn(commits, files).first()["last_commit_at"] == "2024-01-01T23:30:00-05:00"


def test_large_commits_are_skipped(spark):
    commits = spark.createDataFrame([("a",), ("b",)], "commit_id string")
    files = spark.createDataFrame([("a", i) for i in range(51)] + [("b", 0), ("b", 1)], "commit_id string, file_id bigint")
    assert [tuple(r) for r in history.co_changes(commits, files).collect()] == [(0, 1, 1)]
    assert history.commit_totals(commits, files).first()["skipped_large_commits"] == 1


def test_unlinked_edges_keep_their_confidence(spark):
    from graphloom.operators import incremental

    edges = spark.createDataFrame([(1, 5, 50, "heuristic"), (2, 6, 60, "ambiguous"), (3, None, None, "unresolved")], "id bigint, dst_file_id bigint, dst_symbol_id bigint, confidence string")
    got = sorted(tuple(r) for r in incremental.unlink_targets(edges, spark.createDataFrame([(5,)], "id bigint")).collect())
    assert got == [(1, None, None, "heuristic"), (2, 6, 60, "ambiguous"), (3, None, None, "unresolved")]


def test_tarjan_survives_a_long_chain():
    n = 20_000
    label = components.tarjan([(i, i + 1) for i in range(n)] + [(n, n - 1)])
    assert label[n] == label[n - 1] == n - 1 and label[0] == 0


def test_cycles_weight_and_artifact(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 3), ("b", "c", 9)], "src string, dst string, w bigint")
    members = components.strong_components(edges)
    row = components.cycles(members, edges).first()
    assert (row["members"], row["size"], row["internal_edges"]) == (["a", "b"], 2, 5)
    none = spark.createDataFrame([], "path string")
    assert components.artifacts(members, none, none).first()["aggregation_artifact"] is True
    real = spark.createDataFrame([("a/x.ts",)], "path string")
    assert components.artifacts(members, none, real).first()["aggregation_artifact"] is False


def _call_tables(spark):
    files = spark.createDataFrame([(1, "a/x.ts", "typescript"), (2, "b/y.ts", "typescript"), (3, "c/z.ts", "typescript"), (4, "g/p.go", "go"), (5, "g/q.go", "go"), (6, "h/r.go", "go")], "id bigint, path string, lang string")
    symbols = spark.createDataFrame(
        [(10, 1, "local", False, 1), (11, 1, "run", False, 2), (20, 2, "shared", True, 1), (21, 2, "hidden", False, 2), (30, 3, "shared", True, 1), (31, 3, "local", True, 2), (50, 5, "low", False, 1), (60, 6, "Main", False, 1)],
        "id bigint, file_id bigint, name string, exported boolean, start_line int",
    )
    imports = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 6, 4)], "id bigint, file_id bigint, resolved_file_id bigint")
    sites = spark.createDataFrame(
        [(1, 1, "local", "run", "calls", 5), (2, 1, "shared", None, "calls", 6), (3, 1, "hidden", "run", "calls", 7), (4, 4, "low", None, "calls", 1), (5, 2, "shared", None, "calls", 9)],
        "id bigint, file_id bigint, name string, enclosing string, kind string, line int",
    )
    return files, symbols, imports, sites


def test_call_tiers_shadowing_and_fan_out(spark):
    files, symbols, imports, sites = _call_tables(spark)
    got = {}
    for r in calls.resolve_calls(sites, symbols, imports, files).collect():
        got.setdefault(r["id"], []).append((r["ordinal"], r["dst_symbol_id"], r["confidence"], r["src_symbol_id"]))
    assert got[1] == [(1, 10, "heuristic", 11)]  # the local name shadows the export
    assert sorted(got[2]) == [(1, 20, "ambiguous", None), (2, 30, "ambiguous", None)]
    assert got[3] == [(1, None, "unresolved", 11)]  # not exported
    assert got[4] == [(1, 50, "heuristic", None)]  # same package, no import, not exported
    assert got[5] == [(1, 20, "heuristic", None)]


def test_go_imports_take_in_the_package(spark):
    files, _, imports, _ = _call_tables(spark)
    got = {(r["file_id"], r["target"]) for r in calls.import_targets(imports, files).collect()}
    assert got == {(1, 2), (1, 3), (6, 4), (6, 5)}


def test_symbol_walk_emits_every_edge_once_per_first_visit(spark):
    e = spark.createDataFrame([(1, 1, 1, 2, "calls", "heuristic"), (2, 1, 2, 1, "calls", "heuristic"), (3, 1, 2, None, "calls", "unresolved"), (4, 1, 2, 3, "instantiates", "ambiguous")], "id bigint, ordinal bigint, src_symbol_id bigint, dst_symbol_id bigint, kind string, confidence string")
    start = spark.createDataFrame([(1,)], "node bigint")
    found, limited = structure.symbol_walk(e, start, 2)
    assert sorted((r["id"], r["depth"]) for r in found.collect()) == [(1, 1), (2, 2), (3, 2), (4, 2)] and limited
    found, _ = structure.symbol_walk(e, start, 2, "out", "calls", "heuristic")
    assert sorted((r["id"], r["depth"]) for r in found.collect()) == [(1, 1), (2, 2)]


def test_symbol_walk_starts_from_every_symbol_of_the_name(spark):
    from collections import Counter

    from graphloom import registry
    from graphloom.plans.projection import project

    data = "/root/testdata/sf0.001"
    g = project(spark, data)
    edges = registry._edges(g).collect()
    start = {r["id"]: r["file_id"] for r in g.symbols.where("name = 'sym_8'").collect()}
    assert any(f >= 40 for f in start.values())
    depth, level = dict.fromkeys(start, 0), set(start)
    for d in range(1, 3):
        level = {e["dst_symbol_id"] for e in edges if e["src_symbol_id"] in level} - {None} - set(depth)
        depth |= dict.fromkeys(level, d)
    want = Counter((e["id"], e["ordinal"], e["dst_name"], e["confidence"], depth[e["src_symbol_id"]] + 1) for e in edges if e["src_symbol_id"] in depth)
    assert {"ambiguous"} <= {e["confidence"] for e in edges if e["src_symbol_id"] in depth}
    assert Counter(tuple(r) for r in registry.queries()["symbol_walk"](spark, data).collect()) == want


def edge(dst, name, line=1, path="m/a.ts"):
    return {"dst_symbol_id": dst, "dst_name": name, "dst_symbol_name": name, "dst_path": path if dst else None, "line": line, "confidence": "heuristic"}


def test_flow_marks_real_repeats_only():
    graph = {1: [edge(2, "b"), edge(3, "c")], 2: [edge(4, "t")], 3: [edge(4, "t")], 4: [edge(5, "deep")], 5: []}
    start = {"id": 1, "name": "a", "path": "m/a.ts", "line": 1}
    tree = flow.expand_tree(start, graph.__getitem__, 2, 50)
    assert [(r[4], r[9]) for r in tree.rows] == [("a", False), ("b", False), ("t", False), ("c", False), ("t", False)] and tree.depth_limited
    loop = {1: [edge(2, "b")], 2: [edge(1, "a")]}
    tree = flow.expand_tree(start, loop.__getitem__, 5, 50)
    assert [(r[4], r[9]) for r in tree.rows] == [("a", False), ("b", False), ("a", True)] and not tree.depth_limited
    tree = flow.expand_tree(start, {1: [edge(None, "x")] * 9}.__getitem__, 5, 4)
    assert len(tree.rows) == 4 and tree.limit_reached


def test_flow_module_crossing():
    graph = {1: [edge(2, "b", path="n/b.ts"), edge(None, "ext")], 2: []}
    tree = flow.expand_tree({"id": 1, "name": "a", "path": "m/a.ts", "line": 1}, graph.__getitem__, 5, 50)
    assert [r[8] for r in tree.rows] == [False, True, False]


def test_impact_counts_places_once(spark):
    walk = spark.createDataFrame([(1, 1, 7, 3, "ambiguous", 1), (1, 2, 7, 3, "ambiguous", 1), (2, 1, 7, 4, "heuristic", 2), (3, 1, 8, 1, "unresolved", 1)], "id bigint, ordinal bigint, src_file_id bigint, line int, confidence string, depth int")
    files = spark.createDataFrame([(7, "m/a.ts"), (8, "b.ts")], "id bigint, path string")
    refs = impact.references(walk, files)
    assert impact.buckets(refs).first().asDict() == {"total": 3, "verified": 0, "likely": 1, "ambiguous": 2}
    assert {r["module"]: r["count"] for r in impact.by_module(refs).collect()} == {"m": 2, ".": 1}


def _history(spark):
    commits = spark.createDataFrame([(1, "ann", 10, "fix: x"), (2, "bob", 20, "Hotfix(core) y"), (3, "ann", 30, "feat: will fix"), (4, "cy", 40, "patch")], "commit_id bigint, author string, committed_at bigint, subject string")
    touched = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 9)], "commit_id bigint, file_id bigint")
    return commits, touched


def test_churn_and_co_change(spark):
    commits, touched = _history(spark)
    got = {r["file_id"]: (r["commits"], r["authors"], r["bug_fixes"], r["last_commit_at"]) for r in history.churn(commits, touched).collect()}
    assert got == {1: (3, 2, 2, 30), 2: (3, 2, 2, 30), 3: (1, 1, 0, 30), 9: (1, 1, 1, 40)}
    pairs = {(r["a"], r["b"]): r["commits"] for r in history.co_changes(commits, touched, support=3).collect()}
    assert pairs == {(1, 2): 3}
    assert {(r["a"], r["b"]): r["commits"] for r in history.co_changes(commits, touched, large=2).collect()} == {(1, 2): 2}
    assert history.commit_totals(commits, touched, large=2).first().asDict() == {"total_commits": 4, "skipped_large_commits": 1}
    assert history.in_window(commits.withColumn("committed_at", F.current_timestamp()), 0).isEmpty()


@pytest.mark.parametrize("links,left", [([], 1), ([(2, 1)], 0), ([(1, 5), (5, 2)], 0), ([(2, 5), (5, 1)], 0), ([(1, 5), (5, 6), (6, 2)], 1)])
def test_hidden_coupling_looks_two_hops_far(spark, links, left):
    pairs = spark.createDataFrame([(1, 2, 3)], "a bigint, b bigint, commits bigint")
    assert history.hidden_coupling(pairs, spark.createDataFrame(links, "src bigint, dst bigint")).count() == left


def test_hotspots_fan_asymmetry_and_no_history(spark):
    files = spark.createDataFrame([(1, "a", 10), (2, "b", 0)], "id bigint, path string, loc int")
    symbols = spark.createDataFrame([(1, 1)], "id bigint, file_id bigint")
    links = spark.createDataFrame([(1, 1), (1, 2)], "src bigint, dst bigint")
    cyclic = spark.createDataFrame([], "file_id bigint")
    got = {r["path"]: (r["fan_in"], r["fan_out"], r["score"]) for r in history.hotspots(files, symbols, links, cyclic, None).collect()}
    assert got == {"a": (1, 1, 0.8), "b": (1, 0, 0.2)}


def test_search_prefers_exact_then_partial_then_text(spark):
    files = spark.createDataFrame([(1, "a.ts", "typescript"), (2, "b%_.md", None)], "id bigint, path string, lang string")
    symbols = spark.createDataFrame([(1, 1, "dup", "function", 3, True, "function dup()"), (2, 1, "Duplex", "class", 9, False, None)], "id bigint, file_id bigint, name string, kind string, start_line int, exported boolean, signature string")
    hits = search.symbol_hits(symbols, files)
    texts = spark.createDataFrame([("a.ts", "typescript", "x\n\nfunction dup()\n DUP"), ("b%_.md", None, "none")], "path string, lang string, text string")
    got = [(r["path"], r["line"], r["score"], r["snippet"], r["total"]) for r in search.search_code(hits, texts, "dup", 10).collect()]
    assert got == [("a.ts", 3, 100, "function dup()", 3), ("a.ts", 9, 60, "Duplex", 3), ("a.ts", 4, 20, "DUP", 3)]
    assert len(search.search_code(hits, texts, "dup", 1).collect()) == 1 and search.search_code(hits, texts, "dup", 1).first()["total"] == 3
    assert [r["kind"] for r in search.search_code(hits, texts, "dup", 9, kind="class").collect()] == ["symbol"]
    assert search.search_code(hits, texts, "", 5).isEmpty()
    assert search.find_symbols(hits, 5, contains="_", path_prefix="B%").isEmpty()
