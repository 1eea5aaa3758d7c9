"""Repeated windows of a corpus: what suffix-array and substring dedup share.

A *window* is ``width`` consecutive units (bytes or words) of one text.  Both
operators need to know which windows occur more than once, over every window
of every text, without shuffling a record per position.

1. *Anchors.*  Every window picks one of its ``gram``-unit substrings, the one
   whose hash is least (leftmost on ties).  Equal windows pick equal anchors
   at equal places, so a window can only repeat if its anchor does.  Runs of
   neighbouring windows share an anchor; one small row stands for a run.
2. *Pruning.*  Anchors are counted (combined on the map side); runs whose
   anchor occurs once are dropped.
3. *Folding.*  The bytes that a run's windows cover are its *context*.  Runs
   with one anchor and one context fold into their first member before any
   text moves; the others repeat it as a whole.  So a group of copies, however
   large, sends one context.
4. *Groups.*  The distinct contexts of an anchor, the prefix that their
   suffixes share, form a group; groups are packed into buckets of about
   ``bucket_bytes``, and a partition holds whole buckets.  The operator's own
   index (suffix trees, or a family of suffix arrays) finds the repeated
   windows of a bucket, comparing bytes.
5. *Longer prefixes.*  A group of more than ``KEY_BYTES`` is not handed to a
   task.  Its windows split by their place around the anchor into two halves,
   and each half's prefix grows to all that its windows have in common.  The
   new groups are folded and measured again; at the last level the prefix is
   the window itself, whose contexts fold into one.  The same index runs on
   every group, and no step caps or samples anything.

Folding compares 64-bit digests of contexts together with their anchor, number
of windows and place of the anchor; everything else compares bytes or words.

A row is known by its batch, its id and a hash of its text, so rows that share
an id but not a text keep their own ranges; rows without an id are kept apart
by a flag.  Batches matter to ``suffix_dedup`` alone, where texts of earlier
batches come before all of a later one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import kernels as K
from .common import discard, materialize

KEY_BYTES = 512 << 10
PARTITION_BYTES = 64 << 20
#: What names a row of the documents.
ROW = ("batch", "noid", "id", "row")
_PLACE = (1 << 16) - 1


def row_schema(kind: str) -> str:
    return f"batch int, noid boolean, id {kind}, row bigint"


def identified(docs: DataFrame, id_col: str, text_col: str, *more, batch: int = 0) -> DataFrame:
    """(batch, noid, id, row, text, more): ids without nulls and the hash that tells the texts of one id apart."""
    kind = docs.schema[id_col].dataType
    none = F.lit(0 if isinstance(kind, NumericType) else "").cast(kind)
    key = F.col(id_col)
    return docs.select(F.lit(batch).alias("batch"), key.isNull().alias("noid"), F.coalesce(key, none).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"), *more)


def named(rows: DataFrame):
    """The id of an identified row, null where it had none."""
    return F.when(~rows["noid"], rows["id"]).alias("id")


def anchor_runs(codes: np.ndarray, off: np.ndarray, width: int, gram: int):
    """(anchor hash, first window, windows, place of the anchor) of every run of a block."""
    begin = K.inside_windows(off, width)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin, begin
    grams = K.mix(K.window_hashes(codes, gram))
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (K.minimum_over(ranked, width - gram + 1)[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    heads = np.flatnonzero(first)
    return grams[at[heads]], begin[heads], np.diff(np.append(heads, len(at))), at[heads]


def units(buf: np.ndarray, off: np.ndarray, words: bool):
    """(codes, unit offsets by text, byte start and end of each unit or None)."""
    if not words:
        return K.BYTE_CODES[buf], off, None, None
    starts, ends, count = K.tokens(buf, off, K.SPACE_WORD)
    return K.span_hashes(K.prefix_sums(buf), starts, ends), count, starts, ends


def packed(lo: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First window, number of windows and the anchor's place after the first window's start, in one integer."""
    return (lo << 32) | (n << 16) | place


def find_anchors(rows: DataFrame, width: int, gram: int, words: bool) -> DataFrame:
    """A row for every run of every text: (key, ctx, row names, at, span); ``span`` holds the context's first byte and size."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, _, buf, off in K.blocks(batch.column(len(ROW))):
                codes, count, starts, ends = units(buf, off, words)
                key, lo, n, anchor = anchor_runs(codes, count, width, gram)
                if not len(key):
                    continue
                text = np.searchsorted(count, lo, side="right") - 1
                a = starts[lo] if words else lo
                b = ends[lo + n - 1 + width - 1] if words else lo + n + width - 1
                raw = buf.tobytes()
                digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
                at = packed(lo - count[text], n, anchor - lo)
                span = ((a - off[text]) << 32) | (b - a)
                owner = pa.array(text + first)
                arrays = [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), *(batch.column(i).take(owner) for i in range(len(ROW))), pa.array(at), pa.array(span)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "ctx", *ROW, "at", "span"])

    return rows.select(*ROW, "text").mapInArrow(run, f"key bigint, ctx bigint, {row_schema(kind)}, at bigint, span bigint")


def _order():
    """A run's place in the order of the corpus."""
    return [*(F.col(c) for c in ROW), F.shiftright("at", 32).alias("lo")]


def _whole(width: int):
    """The stretch that all windows of a run cover."""
    lo = F.shiftright("at", 32)
    return [*ROW, lo.cast("int").alias("s"), (lo + F.shiftright("at", 16).bitwiseAND(_PLACE) + (width - 1)).cast("int").alias("e")]


def _folded(runs: DataFrame, width: int, earlier_only: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """(ranges, firsts): runs that repeat their context's first member, and that member for each distinct context.

    ``runs`` has (key, ctx, row names, at, span, c); c counts the copies that
    an earlier level folded, whose own windows are known to repeat.
    """
    # Equal contexts have equal numbers of windows and places of the anchor.
    runs = runs.withColumn("shape", F.col("at").bitwiseAND((1 << 32) - 1))
    groups = runs.groupBy("key", "ctx", "shape").agg(F.min(F.struct(*_order(), "at", "span")).alias("first"), F.sum("c").alias("total"))
    groups = materialize(groups, f"{label}-groups")
    joined = runs.join(groups.where("total > 1"), ["key", "ctx", "shape"])
    if earlier_only:
        joined = joined.where(F.struct(*_order()) > F.struct(*(F.col(f"first.{c}") for c in (*ROW, "lo"))))
    else:
        joined = joined.where("c = 1")
    firsts = groups.select("key", "ctx", F.col("total").alias("c"), *(F.col(f"first.{c}").alias(c) for c in (*ROW, "at", "span")))
    return materialize(joined.select(*_whole(width)), f"{label}-ranges"), firsts


def context_blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the batch's context column."""
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def shapes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place) of each run of a batch."""
    at = column(batch, "at")
    return at >> 32, (at >> 16) & _PLACE, at & _PLACE


def ranges(batch: pa.RecordBatch, marked: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows (row names, s, e) of the units covered by marked windows, one for each stretch in a run."""
    lo, n, _ = shapes(batch)
    window_off = np.concatenate([[0], np.cumsum(n)])
    edge = np.zeros(len(marked) + 1, bool)
    edge[window_off] = True
    opens = marked.copy()
    opens[1:] &= ~marked[:-1] | edge[1 : len(marked)]
    closes = marked.copy()
    closes[:-1] &= ~marked[1:] | edge[1 : len(marked)]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    at = np.searchsorted(window_off, a, side="right") - 1
    base = lo[at] - window_off[at]
    owner = pa.array(at)
    names = [batch.column(batch.schema.get_field_index(c)).take(owner) for c in ROW]
    return pa.RecordBatch.from_arrays([*names, pa.array((base + a).astype(np.int32)), pa.array((base + b + width).astype(np.int32))], names=[*ROW, "s", "e"])


def buckets(batches) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(a new bucket begins, rows of one bucket) in the order of the partition."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = column(batch, "bucket")
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield ids[a] != last, batch.slice(a, b - a)
            last = ids[a]


def whole_buckets(batches) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket in one batch."""
    held: list[pa.RecordBatch] = []
    for new, part in buckets(batches):
        if new and held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(part)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _halves(hot: DataFrame, width: int, gram: int, words: bool, level: int, kind: str) -> DataFrame:
    """Level ``level`` of the hot groups: windows split by their place around the anchor, prefixes extended.

    Range r of 2 ** level holds the windows that begin j units before the
    anchor for ja <= j < jb; all of them cover the units from ja before the
    anchor to width - jb + 1 behind it, which become the prefix.
    """
    places, parts = width - gram + 1, 1 << level

    def run(batches):
        for batch in batches:
            lo, n, place = shapes(batch)
            half, out = column(batch, "half"), {c: [] for c in ("key", "ctx", "at", "half", "text", "from")}
            for i, raw in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                if words:
                    buf = np.frombuffer(raw, np.uint8)
                    starts, ends, _ = K.tokens(buf, np.array([0, len(buf)]), K.SPACE_WORD)
                for r in (2 * int(half[i]), 2 * int(half[i]) + 1):
                    ja, jb, p = places * r // parts, places * (r + 1) // parts, int(place[i])
                    least, most = max(p - int(n[i]) + 1, ja), min(p, jb - 1)
                    if least > most:
                        continue
                    a, b, c, d = p - most, p - least + width, p - ja, p - jb + 1 + width  # context and prefix, in units
                    if words:  # one space between words, so that equal words fold
                        prefix, text = (b" ".join(raw[starts[k] : ends[k]] for k in range(*x)) for x in ((c, d), (a, b)))
                    else:
                        prefix, text = raw[c:d], raw[a:b]
                    out["key"].append(xxhash.xxh3_64_intdigest(prefix, seed=parts + r))
                    out["ctx"].append(xxhash.xxh3_64_intdigest(text))
                    out["at"].append(int(packed(int(lo[i]) + a, most - least + 1, most)))
                    out["half"].append(r)
                    out["text"].append(text)
                    out["from"].append(i)
            owner = pa.array(out["from"], pa.int64())
            signed = [pa.array(np.array(out[c], np.uint64).view(np.int64)) for c in ("key", "ctx")]
            names = [batch.column(batch.schema.get_field_index(c)).take(owner) for c in (*ROW, "c")]
            yield pa.RecordBatch.from_arrays([*signed, *names, pa.array(out["at"], pa.int64()), pa.array(out["half"], pa.int32()), pa.array(out["text"], pa.binary())], names=["key", "ctx", *ROW, "c", "at", "half", "text"])

    columns = hot.select(*ROW, "c", "at", "half", "text")
    return columns.mapInArrow(run, f"key bigint, ctx bigint, {row_schema(kind)}, c bigint, at bigint, half int, text binary")


def _hot_keys(contexts: DataFrame, label: str) -> tuple[DataFrame | None, int]:
    """Keys whose contexts, more than one, outgrow a task, and the bytes of all contexts; ``contexts`` has (key, size)."""
    groups = contexts.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    hot = (F.col("size") > KEY_BYTES) & (F.col("n") > 1)
    total, any_hot = groups.agg(F.sum("size"), F.max(hot)).first()
    return (materialize(groups.where(hot).select("key"), f"{label}-hot") if any_hot else None), int(total or 0)


def repeated_ranges(rows: DataFrame, *, width: int, gram: int, words: bool, earlier_only: bool, index: Callable, order: tuple[str, ...], bucket_bytes: int, runs: DataFrame | None = None) -> DataFrame:
    """(row names, s, e): stretches of units inside repeated windows; stretches may overlap.

    ``rows`` are identified.  ``index(batches, width, gram)`` takes a
    partition's contexts, whole buckets sorted by ``order`` within each, and
    yields (batch, mask of its repeated windows).  ``runs`` are the rows' runs
    where they are written already.
    """
    if width - gram >= _PLACE:
        raise ValueError("windows are too wide")
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    if runs is None:
        runs = materialize(find_anchors(rows, width, gram, words), "runs")
    # Written first: a join splits a hot key only where both its sides are plain exchanges.
    many = materialize(runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "anchors")
    kept = materialize(runs.select("key", "ctx", *ROW, "at", "span").join(many, "key").withColumn("c", F.lit(1).cast("bigint")), "kept")
    discard(runs, many)
    done, firsts = _folded(kept, width, earlier_only, "level0")
    discard(kept)
    found = [done]
    size = F.col("span").bitwiseAND((1 << 32) - 1)
    hot, total = _hot_keys(firsts.select("key", size.alias("size")), "level0")
    texts = rows.where(F.col("text").isNotNull()).select(*ROW, F.col("text").cast("binary").alias("raw")).dropDuplicates(list(ROW))
    cut = F.substring("raw", (F.shiftright("span", 32) + 1).cast("int"), size.cast("int")).alias("text")
    met = firsts.join(texts, list(ROW)).select("key", *ROW, "c", "at", F.lit(0).alias("half"), cut)
    if hot is not None:
        met = materialize(met, "contexts")
    level = 0
    while True:
        rest = met if hot is None else met.join(hot, "key", "left_anti")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
        number = max(parts, -(-total // bucket_bytes))
        tidy = rest.select(F.pmod(F.xxhash64("key"), F.lit(number)).cast("int").alias("bucket"), *ROW, "c", "at", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", *order)
        found.append(materialize(tidy.mapInArrow(_searcher(index, width, gram, earlier_only), f"{row_schema(kind)}, s int, e int"), f"level{level}-found"))
        if hot is None:
            break
        level += 1
        split = materialize(_halves(met.join(hot, "key", "left_semi"), width, gram, words, level, kind), f"level{level}-halves")
        discard(met, hot)
        alive = materialize(split.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1").select("key"), f"level{level}-alive")
        split = materialize(split.join(alive, "key").withColumn("span", F.lit(0).cast("bigint")), f"level{level}-split")
        done, firsts = _folded(split, width, earlier_only, f"level{level}")
        found.append(done)
        firsts = firsts.drop("span")
        met = materialize(firsts.join(split.drop("c", "span"), ["key", "ctx", *ROW, "at"]).select("key", *ROW, "c", "at", "half", "text"), f"level{level}-contexts")
        discard(split)
        hot, total = _hot_keys(met.select("key", F.octet_length("text").alias("size")), f"level{level}")
    return reduce(DataFrame.unionByName, found)


def _searcher(index: Callable, width: int, gram: int, earlier_only: bool):
    def run(batches):
        for part, marked in index(batches, width, gram):
            if not earlier_only:  # windows of folded copies are known to repeat
                _, n, _ = shapes(part)
                marked = marked & np.repeat(column(part, "c") == 1, n)
            if marked.any():
                yield ranges(part, marked, width)

    return run


def with_ranges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every identified row with ``ranges``: its stretches, or null."""
    each = found.groupBy(*ROW).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return rows.join(each, list(ROW), "left")


def merge(pairs) -> list[tuple[int, int]]:
    """Overlapping or touching [s, e) joined, in order."""
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def range_lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    """Merged stretches of each row of an array<struct<s, e>> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    s, e = flat.field(0).to_pylist(), flat.field(1).to_pylist()
    size = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    return [merge(zip(s[a:b], e[a:b], strict=True)) if b > a else [] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
