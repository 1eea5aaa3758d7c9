"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins; labels at least halve a path's
length, so rounds grow with the logarithm of the longest chain.  A hub's
neighbours are never gathered in one row: the minimum is a combinable
aggregate and the join on a hub's key can be split.

The driver plans each join of a round again as its inputs become known and
keeps the tables that it broadcasts, so rounds cost its memory whatever the
size of the table.  Up to ``ONE_TASK_LINKS`` links one task joins trees instead.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..session import discard, materialize

#: Up to so many links one task runs a nearly linear algorithm; more go through rounds of stars.
ONE_TASK_LINKS = 200_000


def least_reachable(links: Iterable[tuple]) -> dict:
    """The least member of every node's component."""
    up: dict = {}

    def top(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        batches = list(batches)
        if batches:
            label = least_reachable(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            of = batches[0].schema.types[0]
            yield pa.RecordBatch.from_arrays([pa.array(list(label), of), pa.array(list(label.values()), of)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60, *, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component): the least node reachable, for nodes with a link.

    ``links`` has two columns of one orderable type.  Self-links and links
    with a null end are ignored.
    """
    a, b = links.columns[:2]
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "cc")
    # Python orders integers and strings as Spark does.
    plain = isinstance(edges.schema["u"].dataType, IntegralType | StringType)
    before = None
    for _ in range(max_rounds):
        # Stars only: every left end has one link and no right end is a left end.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if plain and state[0] <= one_task_links:
            return _in_one_task(edges)
        if state[0] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        # Written between the stars: the small one reads its input three times, and each time would be planned again.
        wide = materialize(_large_star(edges), "cc")
        after = materialize(_small_star(wide), "cc")
        discard(edges, wide)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
