"""File and module graphs: adjacency, coupling, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import module_of
from ..functions.scores import at_least, four_digits
from ..session import materialize


def file_links(imports: DataFrame, files: DataFrame, *, self_links: bool = False) -> DataFrame:
    """(src, dst) file ids: distinct resolved imports; self-imports only on request."""
    links = imports.where(F.col("resolved_file_id").isNotNull()).select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()
    known = files.select("id")
    links = links.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return links if self_links else links.where("src <> dst")


def file_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, a, dst, b): distinct file dependencies with their paths, self-edges dropped."""
    links = file_links(imports, files)
    a = files.select(F.col("id").alias("src"), F.col("path").alias("a"))
    b = files.select(F.col("id").alias("dst"), F.col("path").alias("b"))
    return links.join(a, "src").join(b, "dst").select("src", "a", "dst", "b")


def module_edges(edges: DataFrame) -> DataFrame:
    """(f, t, w): distinct file pairs between two modules."""
    pairs = edges.select(module_of("a").alias("f"), module_of("b").alias("t")).where("f <> t")
    return pairs.groupBy("f", "t").agg(F.count(F.lit(1)).alias("w"))


def coupling(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, ca, ce, instability, files) of every module; ``modules`` are module edges."""
    sizes = files.groupBy(module_of("path").alias("module")).agg(F.count(F.lit(1)).alias("files"))
    # One pass over the edges instead of two: each edge counts for both its ends.
    ends = modules.select(F.explode(F.array(F.struct(F.col("f").alias("module"), F.lit(1).alias("ce"), F.lit(0).alias("ca")), F.struct(F.col("t").alias("module"), F.lit(0).alias("ce"), F.lit(1).alias("ca")))).alias("x")).select("x.*")
    degree = ends.groupBy("module").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    out = sizes.join(degree, "module", "left").na.fill(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    return out.select("module", "ca", "ce", F.when(total == 0, F.lit(0.0)).otherwise(four_digits(F.col("ce") / total)).alias("instability"), "files")


#: A frontier of up to so many nodes is carried by the driver and broadcast; a larger one stays a table.
SMALL = 10_000


def _small(nodes: DataFrame, small: int) -> list | None:
    """The distinct nodes, if they are few."""
    found = [r[0] for r in nodes.distinct().limit(small + 1).collect()]
    return found if len(found) <= small else None


def bfs(links: DataFrame, start: DataFrame, depth: int, direction: str = "out", small: int = SMALL) -> tuple[DataFrame, bool]:
    """((node, depth), whether the last frontier was not empty).

    ``start`` has the column node; start nodes are not returned.  While the
    frontier is small a hop is one scan of the links against a broadcast of
    bounded size.  From the hop on at which it is not, every round writes its
    frontier, so that plans stay short and a lost executor costs one round at
    most.
    """
    spark = links.sparkSession
    kind = start.schema["node"].dataType.simpleString()
    step = links.select("src", "dst") if direction == "out" else links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    frontier = _small(start.select("node"), small)
    if frontier is None:
        return _wide_bfs(step, materialize(start.select("node").distinct(), "bfs"), None, 1, depth)
    seen, rows = set(frontier), []
    for d in range(1, depth + 1):
        if not frontier:
            break
        here = spark.createDataFrame([(n,) for n in frontier], f"src {kind}")
        reached = step.join(F.broadcast(here), "src", "left_semi").select(F.col("dst").alias("node"))
        found = _small(reached, small)
        if found is None:
            before = spark.createDataFrame([(n, 0) for n in seen - {x for x, _ in rows}] + rows, f"node {kind}, depth int")
            return _wide_bfs(step, here.withColumnRenamed("src", "node"), before, d, depth)
        frontier = [n for n in found if n not in seen]
        seen.update(frontier)
        rows += [(n, d) for n in frontier]
    return spark.createDataFrame(rows, f"node {kind}, depth int"), bool(frontier)


def _wide_bfs(step: DataFrame, frontier: DataFrame, before: DataFrame | None, hop: int, depth: int) -> tuple[DataFrame, bool]:
    """The hops from ``hop`` on, as joins; ``before`` has what was seen, the start at depth 0."""
    step = materialize(step, "bfs-links")  # every round reads it
    seen = before if before is not None else frontier.select("node", F.lit(0).alias("depth"))
    limited = not frontier.isEmpty()
    for d in range(hop, depth + 1):
        if not limited:
            break
        reached = step.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(seen, "node", "left_anti"), "bfs")
        limited = not frontier.isEmpty()
        seen = seen.unionByName(frontier.select("node", F.lit(d).alias("depth")))
    return seen.where("depth > 0"), limited


def symbol_walk(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", kind: str | None = None, min_confidence: str | None = None, small: int = SMALL) -> tuple[DataFrame, bool]:
    """(edge columns, depth): every edge of each symbol at its first depth, as a bag.

    Filters hold for what is emitted and for what is expanded.  ``depth`` is
    the distance of the edge's far end.  ``edges`` is a stored table: every hop
    reads two columns of it.
    """
    usable = edges.where(at_least("confidence", min_confidence))
    if kind is not None:
        usable = usable.where(F.col("kind") == kind)
    near, far = ("src_symbol_id", "dst_symbol_id") if direction == "out" else ("dst_symbol_id", "src_symbol_id")
    links = usable.where(F.col(near).isNotNull() & F.col(far).isNotNull()).select(F.col(near).alias("src"), F.col(far).alias("dst"))
    reached, limited = bfs(links, start, depth, "out", small)
    first = start.select("node", F.lit(0).alias("depth")).distinct().unionByName(reached.where(F.col("depth") < depth))
    out = usable.join(first.select(F.col("node").alias(near), (F.col("depth") + 1).alias("depth")), near)
    return out.select(*edges.columns, "depth"), limited
