"""Strongly connected components and what is said about cycles."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import module_of
from ..session import discard, materialize
from .undirected import connected_components

#: Up to so many edges one task runs the linear algorithm; more are trimmed, contracted and their paths shortened until that holds,
#: and only a core that is still too large where none of these helps goes through rounds of joins, as many as its diameter.
ONE_TASK_EDGES = 200_000


def tarjan(edges: Iterable[tuple]) -> dict:
    """Component label (least member) of every node, with an explicit stack."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, stack, label = {}, {}, set(), [], {}
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    least = min(members)
                    label.update((m, least) for m in members)
    return label


def trim(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Drops edges that cannot lie on a cycle: their end has no way on or no way in."""
    left = edges.count()
    for _ in range(rounds):
        kept = materialize(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "trim")
        now = kept.count()
        edges = kept
        if now == left or now == 0:
            break
        left = now
    return edges


def _through(edges: DataFrame) -> DataFrame:
    """(node, prv, nxt) of the nodes with one way in and one way out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("nxt")).where("n = 1").drop("n")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("prv")).where("n = 1").drop("n")
    return out.join(into, "node").select("node", "prv", "nxt")


def compress(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(shorter edges, hanging (node, head, tail), rings (node, component)), or None where no path can be shortened.

    Every path of nodes with one way in and one way out becomes one edge from
    its head to its tail; its nodes hang on that edge.  A ring of nothing but
    such nodes is a component by itself.  The ends are found by pointer
    doubling, in rounds that grow with the logarithm of the longest path.
    """
    chain = materialize(_through(edges).withColumn("least", F.col("node")), "scc-chain")
    size = chain.count()
    if not size:
        return None
    path = chain
    for _ in range(size.bit_length() + 1):
        ahead = path.select(F.col("node").alias("nxt"), F.col("nxt").alias("n2"), F.col("least").alias("l2"))
        behind = path.select(F.col("node").alias("prv"), F.col("prv").alias("p2"))
        both = path.join(ahead, "nxt", "left").join(behind, "prv", "left")
        path = materialize(both.select("node", F.coalesce("p2", "prv").alias("prv"), F.coalesce("n2", "nxt").alias("nxt"), F.least("least", F.coalesce("l2", "least")).alias("least"), (F.col("n2").isNotNull() | F.col("p2").isNotNull()).alias("open")), "scc-chain")
        if path.where("open").isEmpty():
            break
        path = path.drop("open")
    names = chain.select(F.col("node").alias("nxt"))
    rings = path.join(names, "nxt", "left_semi").select("node", F.col("least").alias("component"))
    hanging = materialize(path.join(names, "nxt", "left_anti").select("node", F.col("prv").alias("head"), F.col("nxt").alias("tail")), "scc-hanging")
    inner = chain.select("node")
    rest = edges.join(inner.toDF("src"), "src", "left_anti").join(inner.toDF("dst"), "dst", "left_anti").select("src", "dst")
    shorter = rest.unionByName(hanging.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()
    return materialize(shorter, "scc-shorter"), hanging, materialize(rings, "scc-rings")


def _labels(edges: DataFrame, kind: str) -> DataFrame:
    """(node, component) of each task's own edges."""

    def run(batches):
        rows = [x for pdf in batches for x in zip(pdf["src"], pdf["dst"], strict=True)]
        if rows:
            label = tarjan(rows)
            yield pd.DataFrame({"node": list(label), "component": list(label.values())})

    return edges.mapInPandas(run, f"node {kind}, component {kind}")


def _within_blocks(edges: DataFrame, kind: str, blocks: int) -> DataFrame:
    """(node, least): nodes that lie on a cycle of one block of edges; a block is a range of their starts."""
    return _labels(edges.repartitionByRange(blocks, "src", "dst"), kind).where("node <> component").toDF("node", "least")


def _both_ways(edges: DataFrame) -> DataFrame:
    """(node, least): nodes joined by chains of pairs that link both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = edges.where("src < dst").join(back, ["src", "dst"], "left_semi")
    return connected_components(pairs).where("node <> component").toDF("node", "least")


def contract(edges: DataFrame, kind: str, blocks: int, many: int) -> tuple[DataFrame, DataFrame] | None:
    """(fewer edges, (node, least) of the nodes that went), or None where a tenth of the ``many`` edges doesn't go.

    Nodes that are known to lie in one component become its least known node.
    Neither the blocks nor the pairs need rounds that follow the diameter.
    """
    for find in (lambda: _within_blocks(edges, kind, blocks), lambda: _both_ways(edges)):
        # A node with starts in two blocks may have a row of each; both are of one component, and one is enough.
        gone = materialize(find().groupBy("node").agg(F.min("least").alias("least")), "scc-gone")
        moved = edges.join(gone.toDF("src", "s"), "src", "left").join(gone.toDF("dst", "d"), "dst", "left")
        fewer = materialize(moved.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).where("src <> dst").distinct(), "scc-fewer")
        if fewer.count() <= 0.9 * many:
            return fewer, gone
        discard(fewer, gone)
    return None


def _components(core: DataFrame, kind: str, one_task_edges: int) -> DataFrame:
    """(node, component) of nodes on cycles; ``core`` has distinct edges and may have self-edges."""
    many = core.count()
    if many > one_task_edges:
        core = trim(core)
        many = core.count()
    if many <= one_task_edges:
        return _labels(core.coalesce(1), kind)
    contracted = contract(core.where("src <> dst"), kind, -(-many // max(one_task_edges, 100)) + 1, many)
    if contracted is not None:
        edges, gone = contracted
        found = materialize(_components(edges, kind, one_task_edges), "scc-inner")
        back = gone.join(found.toDF("least", "c"), "least", "left").select("node", "least", F.coalesce("c", "least").alias("component"))
        every = found.unionByName(back.select("node", "component")).unionByName(back.select(F.col("least").alias("node"), "component"))
        return every.groupBy("node").agg(F.min("component").alias("component"))
    loops = core.where("src = dst").select(F.col("src").alias("node"))
    short = compress(core.where("src <> dst"))
    if short is None:
        return _by_colouring(core.where("src <> dst"), kind)
    edges, hanging, rings = short
    found = materialize(_components(edges, kind, one_task_edges), "scc-inner")
    ends = found.unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    own = hanging.where("head = tail").select(F.col("head").alias("node"), F.col("head").alias("component"))
    ends = materialize(ends.unionByName(own).groupBy("node").agg(F.min("component").alias("component")), "scc-ends")
    met = hanging.join(ends.toDF("head", "ch"), "head").join(ends.toDF("tail", "ct"), "tail").where("ch = ct").select("node", F.col("ch").alias("component"))
    every = materialize(ends.unionByName(met).distinct(), "scc-every")
    least = every.groupBy("component").agg(F.min("node").alias("least"))
    return every.join(least, "component").select("node", F.col("least").alias("component")).unionByName(rings)


def strong_components(edges: DataFrame, *, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) of the nodes on cycles of two and more; the label is the least member.

    ``edges`` has (src, dst), without self-edges.
    """
    core = materialize(edges.select("src", "dst").distinct(), "scc")
    found = _components(core, core.schema["src"].dataType.simpleString(), one_task_edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


def _by_colouring(edges: DataFrame, kind: str) -> DataFrame:
    """Forward-colouring: nodes take the greatest label that reaches them; a colour's
    root and what reaches it back within the colour are one component."""
    done = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = materialize(nodes.withColumn("colour", F.col("node")), "scc-colour")
        while True:  # labels only grow, so this ends; without paths to walk it takes few rounds
            pushed = edges.join(colour.toDF("src", "c"), "src").groupBy("dst").agg(F.max("c").alias("c"))
            fresh = materialize(colour.join(pushed, colour.node == pushed.dst, "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour")), "scc-colour")
            moved = fresh.join(colour.toDF("node", "old"), "node").where("colour <> old").isEmpty()
            colour = fresh
            if moved:
                break
        inner = edges.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        inner = materialize(inner, "scc-inner")
        reach = materialize(colour.where("node = colour"), "scc-back")
        frontier = reach
        while not frontier.isEmpty():
            more = inner.join(frontier.toDF("dst", "colour"), ["dst", "colour"], "left_semi").select(F.col("src").alias("node"), "colour").distinct()
            frontier = materialize(more.join(reach, ["node", "colour"], "left_anti"), "scc-back")
            reach = reach.unionByName(frontier)
        least = reach.groupBy("colour").agg(F.min("node").alias("component"))
        done = materialize(done.unionByName(reach.join(least, "colour").select("node", "component")), "scc-done")
        gone = reach.select("node")
        edges = trim(edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    return done


def cycles(members: DataFrame, edges: DataFrame, min_size: int = 2) -> DataFrame:
    """(component, members, size, internal_edges): ``edges`` has (src, dst, w)."""
    groups = members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size"))
    inside = edges.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "cd"), "dst").where("cs = cd")
    weight = inside.groupBy(F.col("cs").alias("component")).agg(F.sum("w").alias("internal_edges"))
    return groups.where(F.col("size") >= min_size).join(weight, "component")


def cycle_hops(members: DataFrame, module_graph: DataFrame, edges: DataFrame, examples: int = 3) -> DataFrame:
    """(component, f, t, n_pairs, via_from, via_to): file pairs behind each module edge inside a cycle."""
    inner = module_graph.join(members.toDF("f", "component"), "f").join(members.toDF("t", "ct"), "t").where("component = ct").select("component", "f", "t")
    pairs = edges.select("a", "b", module_of("a").alias("f"), module_of("b").alias("t")).join(inner, ["f", "t"])
    # Two levels, so that a pair of modules with very many file pairs never meets in one task: each part keeps its first examples.
    part = pairs.withColumn("_part", F.pmod(F.xxhash64("a", "b"), F.lit(64)))
    kept = W.partitionBy("component", "f", "t", "_part").orderBy("a", "b")
    some = part.withColumn("rank", F.row_number().over(kept)).where(F.col("rank") <= examples)
    first = W.partitionBy("component", "f", "t").orderBy("a", "b")
    ranked = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= examples)
    counts = pairs.groupBy("component", "f", "t").agg(F.count(F.lit(1)).alias("n_pairs"))
    return ranked.join(counts, ["component", "f", "t"]).select("component", "f", "t", "n_pairs", "rank", F.col("a").alias("via_from"), F.col("b").alias("via_to"))


def artifacts(members: DataFrame, file_members: DataFrame, self_importers: DataFrame) -> DataFrame:
    """(component, aggregation_artifact): false where a file cycle or a self-import lies in a member module.

    ``file_members`` and ``self_importers`` have the column path.
    """
    real = file_members.select(module_of("path").alias("node")).unionByName(self_importers.select(module_of("path").alias("node"))).distinct()
    return members.join(real.withColumn("real", F.lit(1)), "node", "left").groupBy("component").agg(F.max("real").isNull().alias("aggregation_artifact"))
