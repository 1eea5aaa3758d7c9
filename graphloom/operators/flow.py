"""Call-flow trees: bounded depth-first expansion from one symbol."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE = "node_id int, parent_id int, ordinal int, depth int, name string, path string, line int, confidence string, crosses_module boolean, repeated boolean"


def module_name(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else "."


@dataclass
class Tree:
    rows: list[tuple] = field(default_factory=list)
    depth_limited: bool = False
    limit_reached: bool = False


def expand_tree(start: dict, edges_of: Callable[[int], list[dict]], max_depth: int, limit: int) -> Tree:
    """Pre-order rows of the tree below ``start`` (id, name, path, line).

    ``limit`` bounds all nodes, the root included.  A symbol is expanded
    where it is met first and never again; a later mention is ``repeated``
    only if that expansion had begun, not if depth or budget had stopped it.
    """
    tree = Tree([(0, None, 0, 0, start["name"], start["path"], start["line"], "exact", False, False)])
    begun: dict[int, bool] = {start["id"]: False}

    def open_node(symbol: int, depth: int) -> bool:
        if len(tree.rows) >= limit:
            tree.limit_reached = True
            return False
        if depth > max_depth:
            tree.depth_limited = True
            return False
        begun[symbol] = True
        return True

    stack = []
    if open_node(start["id"], 1):
        stack.append((0, module_name(start["path"]), 1, iter(edges_of(start["id"])), [0]))
    while stack:
        parent, module, depth, rest, counter = stack[-1]
        edge = next(rest, None)
        if edge is None:
            stack.pop()
            continue
        if len(tree.rows) >= limit:
            tree.limit_reached = True
            stack.pop()
            continue
        target, path = edge["dst_symbol_id"], edge["dst_path"]
        known = target is not None and target in begun
        node = len(tree.rows)
        name = edge["dst_symbol_name"] if target is not None and edge["dst_symbol_name"] else edge["dst_name"]
        tree.rows.append((node, parent, counter[0], depth, name, path, edge["line"], edge["confidence"], path is not None and module_name(path) != module, target is not None and begun.get(target, False)))
        counter[0] += 1
        if target is not None and not known:
            begun[target] = False
            if open_node(target, depth + 1):
                stack.append((node, module if path is None else module_name(path), depth + 1, iter(edges_of(target)), [0]))
    return tree


def fetcher(details: DataFrame, limit: int) -> Callable[[int], list[dict]]:
    """Edges of a symbol in order, at most ``limit`` of them (no tree can show more).

    A miss loads the symbol together with the symbols that it calls, so a tree
    of n nodes costs far fewer than n jobs, and never more than n.
    """
    known: dict[int, list[dict]] = {}
    order = W.partitionBy("src_symbol_id").orderBy("id", "ordinal")
    ranked = details.where("src_symbol_id is not null").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)

    def load(ids: list[int]) -> None:
        for i in ids:
            known[i] = []
        for r in ranked.where(F.col("src_symbol_id").isin(ids)).orderBy("src_symbol_id", "_rank").collect():
            known[r["src_symbol_id"]].append(r.asDict())

    def edges_of(symbol: int) -> list[dict]:
        if symbol not in known:
            load([symbol])
            ahead = sorted({e["dst_symbol_id"] for e in known[symbol]} - {None} - set(known))
            if ahead:
                load(ahead)
        return known[symbol]

    return edges_of


def trace_flow(hits: DataFrame, details: DataFrame, entry: str, *, path_prefix: str | None = None, max_depth: int = 4, limit: int = 50) -> Tree | None:
    """The tree of the first symbol named ``entry``; None where there is none.

    ``hits`` are symbols with paths, ``details`` edges with the names and
    paths of their ends.
    """
    from .search import symbol_filter

    first = hits.where(symbol_filter(name=entry, path_prefix=path_prefix)).orderBy(F.length("name"), "name", "path", "id").limit(1).collect()
    if not first:
        return None
    start = {"id": first[0]["id"], "name": first[0]["name"], "path": first[0]["path"], "line": first[0]["start_line"]}
    return expand_tree(start, fetcher(details, limit), max_depth, limit)
