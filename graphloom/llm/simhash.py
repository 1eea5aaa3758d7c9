"""SimHash near-duplicate detection with pigeonring candidate filtering.

A text's 64-bit fingerprint is the bitwise majority over the XXH64 hashes of
its word shingles.  Two fingerprints link when they differ in at most
``max_bits`` bits; a document's class is its connected component.

Candidates come from the pigeonring principle.  Lay ``m`` segments of the
fingerprint on a ring.  If the whole differs in at most ``t`` bits, some
segment starts a chain in which, for every length ``l`` up to ``m``, the first
``l`` segments together differ in at most ``floor(l * t / m)`` bits.  With
``m = t + 1`` (three at least) the first segment must agree and the second may differ in at
most one bit, so the *chain key* (start, first segment, second segment) is
probed with its few admissible variants; the join then walks the remaining
chain and only what survives meets the full Hamming check.  No link is lost
and nothing is capped.

Work follows the distinct fingerprints, not the documents: exact copies fold
into one fingerprint before any join.  Linking runs in three rounds.  The first
links every fingerprint to the smallest one that shares its chain key, the
second to the smallest one at each variant of it; both are linear in the
fingerprints, and together they leave few groups of a dense cloud apart.  The
third joins the full candidate sets but only keeps links between different
groups, so a large group of near copies never emits its pairs.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; texts with fewer words than a
shingle are one shingle; every row gets a result, repeated rows equal ones;
rows that share an id are classed each by its own text; a row without an id
links like any other but never names a class, which is null where no member
has an id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, materialize
from .components import connected_components

SEED = 42
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bit set where over half of a text's hashes have it; 0 for no hashes.

    Bits are counted eight at a time in byte lanes, at most 255 hashes to a
    lane before the lanes are widened.
    """
    n_text = len(off) - 1
    out = np.zeros(n_text, np.uint64)
    counts = np.diff(off)
    if not len(hashes):
        return out
    live = np.flatnonzero(counts)
    pieces = -(-counts[live] // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(off[:-1][live] - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        wide = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(wide, first, axis=0)
        over = (2 * total > counts[live][:, None]).astype(np.uint64)
        for lane in range(8):
            out[live] |= over[:, lane] << np.uint64(8 * lane + bit)
    return out


def shingle_hashes(column, width: int):
    """(lo, hi, hashes, offsets) of each block: the hashes of its texts' word shingles."""
    xx = xxhash.xxh64_intdigest
    for lo, hi, buf, off in K.blocks(column):
        starts, ends, words = K.tokens(buf, off, K.SPACE_WORD)
        if not len(starts):
            yield lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64)
            continue
        size = ends - starts
        to = np.cumsum(size + 1) - size - 1  # words end to end, one space between
        source = np.arange(int(size.sum()), dtype=np.int64)
        source += np.repeat(starts - (np.cumsum(size) - size), size)
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        gap = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(np.arange(len(size)), size)
        joined[gap] = K.LOWER[buf[source]]
        count = np.diff(words)
        short = np.flatnonzero((count > 0) & (count < width))
        begin = K.inside_windows(words, width)
        end_word = begin + width - 1
        if len(short):
            begin = np.concatenate([begin, words[:-1][short]])
            end_word = np.concatenate([end_word, words[1:][short] - 1])
            order = np.argsort(begin, kind="stable")
            begin, end_word = begin[order], end_word[order]
        raw = joined.tobytes()
        spans = zip(to[begin].tolist(), (to[end_word] + size[end_word]).tolist(), strict=True)
        hashes = np.fromiter((xx(raw[a:b], SEED) for a, b in spans), np.uint64, len(begin))
        yield lo, hi, hashes, np.searchsorted(begin, words)


def text_fingerprints(column, width: int) -> np.ndarray:
    """Fingerprint of each text of an Arrow column."""
    out = np.zeros(len(column), np.uint64)
    for lo, hi, hashes, off in shingle_hashes(column, width):
        out[lo:hi] = majority_bits(hashes, off)
    return out


def fingerprints(docs: DataFrame, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp BIGINT) for every row."""

    def run(batches):
        for batch in batches:
            fp = text_fingerprints(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(low bit, bits) of each segment of a 64-bit fingerprint."""
    cut = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def segment_count(max_bits: int) -> int:
    """One more than the bits that may differ, and three at least: the first segment of a chain agrees."""
    return max(max_bits + 1, 3)


def _segment(fp, low: int, bits: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _chain_keys(fp, max_bits: int, variants: bool):
    """Array of chain keys: (start, first segment, second segment), packed.

    The first segment agrees and the second differs in at most
    floor(2t / m) bits, one at most; ``variants`` adds those neighbours.
    """
    bounds = segment_bounds(segment_count(max_bits))
    keys = []
    for i, (low, bits) in enumerate(bounds):
        low2, bits2 = bounds[(i + 1) % len(bounds)]
        base = F.shiftleft(F.lit(i).cast("long"), bits).bitwiseOR(_segment(fp, low, bits))
        second = _segment(fp, low2, bits2)
        for flip in [0] + ([1 << b for b in range(bits2)] if variants and 2 * max_bits >= len(bounds) else []):
            keys.append(F.shiftleft(base, bits2).bitwiseOR(second.bitwiseXOR(F.lit(flip).cast("long"))))
    return F.array(*keys)


def _chain_holds(a, b, max_bits: int):
    """Some start of the ring keeps every prefix within its budget."""
    bounds = segment_bounds(segment_count(max_bits))
    m = len(bounds)
    diff = a.bitwiseXOR(b)
    part = [F.bit_count(_segment(diff, low, bits)) for low, bits in bounds]
    starts = []
    for i in range(m):
        run, ok = part[i], part[i] <= max_bits // m
        for length in range(2, m + 1):
            run = run + part[(i + length - 1) % m]
            ok = ok & (run <= length * max_bits // m)
        starts.append(ok)
    found = starts[0]
    for s in starts[1:]:
        found = found | s
    return found


def _grouped(distinct: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """(fp, g): every fingerprint with the component that ``links`` give it."""
    groups = materialize(connected_components(links), label)
    return distinct.join(groups, distinct.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("g"))


def fingerprint_links(distinct: DataFrame, max_bits: int) -> list[DataFrame]:
    """Links (a, b) between distinct fingerprints ``fp``, found in three rounds.

    Every pair of fingerprints within ``max_bits`` bits is connected by the
    returned links, though not each pair is listed.
    """
    a, b = F.col("a"), F.col("b")
    full = F.bit_count(a.bitwiseXOR(b)) <= max_bits
    exact = distinct.select(F.col("fp").alias("a"), F.explode(_chain_keys(F.col("fp"), max_bits, False)).alias("key"))
    heads = materialize(exact.groupBy("key").agg(F.min("a").alias("b")), "simhash-heads")
    first = materialize(exact.join(heads, "key").where((a != b) & full).select("a", "b").distinct(), "simhash-first")
    tagged = _grouped(distinct, first, "simhash-groups")
    heads_of = heads.withColumnRenamed("b", "fp").join(tagged, "fp").select(F.col("fp").alias("b"), F.col("g").alias("gb"), F.col("key").alias("key2"))

    def probes(tagged: DataFrame) -> DataFrame:
        return tagged.select(F.col("fp").alias("a"), F.col("g").alias("ga"), F.explode(_chain_keys(F.col("fp"), max_bits, True)).alias("key"))

    meets = (F.col("key") == F.col("key2")) & (F.col("ga") != F.col("gb")) & _chain_holds(a, b, max_bits) & full
    second = materialize(probes(tagged).join(heads_of, meets).select("a", "b").distinct(), "simhash-second")
    tagged = materialize(_grouped(distinct, first.unionByName(second), "simhash-groups"), "simhash-tagged")
    index = tagged.select(F.col("fp").alias("b"), F.col("g").alias("gb"), F.explode(_chain_keys(F.col("fp"), max_bits, False)).alias("key2"))
    third = probes(tagged).join(index, meets).select("a", "b").distinct()
    return [first, second, third]


def near_duplicates(docs: DataFrame, *, width: int = 5, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): each document's fingerprint and class."""
    if not 0 <= max_bits <= 20:
        raise ValueError("max_bits must lie between 0 and 20")
    prints = materialize(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    first, second, third = fingerprint_links(distinct.select("fp"), max_bits)
    links = materialize(first.unionByName(second).unionByName(third), "simhash-links")
    members = materialize(connected_components(links), "simhash-members")
    classes = distinct.join(members, distinct.fp == members.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = classes.join(classes.groupBy("c").agg(F.min("least").alias("component")), "c").select("fp", "component")
    # Written first: the join can split the fingerprint of a large group of copies only between plain exchanges.
    out = prints.join(materialize(named, "simhash-named"), "fp").select("id", "fp", "component")
    discard(first, second, third, links)
    return out
