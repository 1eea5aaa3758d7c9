"""Near copies by SimHash and by the overlap of word-shingle sets, found without a loss.

Two texts link when the Jaccard similarity of their sets of word shingles
reaches a threshold; a document's class is its connected component.

The SimHash operator's fingerprints and its pigeonring search give the first
candidates: texts of one fingerprint, and of fingerprints within ``BITS`` bits.
At a Jaccard similarity of 0.8 fingerprints differ in some ten bits, too many
for any selective chain key, so SimHash alone would leave those pairs.

The rest come from the prefix principle.  Put the shingles of every text in
one common order.  Texts of x and y shingles that reach the threshold share at
least ``need`` of them, so the first one that they share stands within a short
prefix of both, and at its places i and j neither x - i nor y - j is less than
``need``.  Any common order finds every pair; a good one puts rare shingles
first, so that few texts meet.  Here half of all shingles (chosen by their
hash) are counted over every text.  Those in at most ``RARE`` texts come
first, the uncounted half next, and the others last, the most frequent at the
very end.  A passage that many texts share thus stays out of their prefixes,
whatever their number, unless a text consists of little else.

Linking runs in three rounds, so that a large group of near copies never emits
its pairs: the SimHash candidates, and every text with the least likely one that
heads a shingle of its prefix; then, for each shingle, one text of every group that the links so far
give; then all candidates that still lie in different groups.  A candidate
meets a sketch first, the parities of its shingles in 512 cells: two sets
differ in at least as many shingles as their sketches do in bits, so no pair
is lost by it; the last two rounds test it inside the join, so that the
rest leave no row.  What passes is checked on the whole sets, and nothing is
capped.

Shingles are compared by 64-bit hashes, sets that are equal by a hash of them.

Defined results: a null text counts as empty; texts without words are copies of
one another; texts with fewer words than a shingle are one shingle; rows that
share an id are one document with several texts; a null id drops out of the
result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components
from .simhash import SEED, fingerprint_links, majority_bits, shingle_hashes

#: Counted shingles in at most so many texts come first in the common order.
RARE = 3
#: 64-bit words of a sketch.
WORDS = 8
#: Fingerprints of SimHash candidates differ in at most so many bits.
BITS = 4


def shingle_sets(column, width: int):
    """(lo, hi, shingles, offsets) of each block: every text's distinct shingles, ascending."""
    for lo, hi, hashes, off in shingle_hashes(column, width):
        yield lo, hi, *_distinct(hashes, off)


def _distinct(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): every text's distinct hashes, ascending."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(off)))


def _counted(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(1)) == 0


def common_order(hashes: np.ndarray, off: np.ndarray, late: pa.Array) -> np.ndarray:
    """The shingles of each text in the common order; ``late`` lists each text's frequent ones as (h, n)."""
    rank = np.where(_counted(hashes), 0, 1).astype(np.int64)
    size = np.array([0 if n is None else n for n in late.value_lengths().to_pylist()], np.int64)
    flat = late.flatten()
    h, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    h, at = h.view(np.uint64), np.concatenate([[0], np.cumsum(size)])
    for t in np.flatnonzero(size).tolist():
        own = hashes[off[t] : off[t + 1]]
        if len(own):
            mine = h[at[t] : at[t + 1]]
            place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            same = own[place] == mine
            rank[off[t] + place[same]] = 1 + n[at[t] : at[t + 1]][same]
    return hashes[np.lexsort((hashes, rank, np.repeat(np.arange(len(off) - 1), np.diff(off))))]


def _frequent(rows: DataFrame, width: int) -> DataFrame:
    """(id, late): the counted shingles (h, n) of each document that more than ``RARE`` texts have."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, hashes, off in shingle_sets(batch.column(1), width):
                keep = _counted(hashes)
                owner = np.repeat(np.arange(lo, hi), np.diff(off))[keep]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), batch.column(0).take(pa.array(owner))], names=["h", "id"])

    each = rows.select("id", "text").mapInArrow(run, f"h bigint, id {kind}")
    # Written first: a join splits a hot key only where both its sides are plain exchanges.
    many = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE), "near-frequent")
    found = materialize(each.join(many, "h").groupBy("id").agg(F.collect_set(F.struct("h", "n")).alias("late")), "near-late")
    discard(many)
    return found


def _sketches(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Parities of each set's shingles in the cells: ``WORDS`` 64-bit words a set."""
    n, cells = len(off) - 1, 64 * WORDS
    at = np.repeat(np.arange(n), np.diff(off)) * cells + (values % np.uint64(cells)).astype(np.int64)
    odd = np.bincount(at, minlength=n * cells).reshape(n, cells) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _signed(off: np.ndarray, values: np.ndarray) -> np.ndarray:
    raw = values.tobytes()
    sig = (xxhash.xxh64_intdigest(raw[8 * a : 8 * b], SEED) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
    return np.fromiter(sig, np.uint64, len(off) - 1).view(np.int64)


def _lists(off: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))


def _prefixes(rows: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(id, sig, fp, n, sketch, s): hash, SimHash fingerprint, size, sketch and prefix of each text's set; ``rows`` has (id, text, late)."""
    kind = rows.schema["id"].dataType.simpleString()
    num, den = similarity

    def run(batches):
        for batch in batches:
            for lo, hi, hashes, off in shingle_hashes(batch.column(1), width):
                fp = majority_bits(hashes, off)
                values, off = _distinct(hashes, off)
                sig, sketch, size = _signed(off, values), _sketches(values, off), np.diff(off)
                values = common_order(values, off, batch.column(2).slice(lo, hi - lo))
                keep = np.where(size > 0, size - -(-size * num // den) + 1, 0)
                head = values[np.arange(len(values)) - np.repeat(off[:-1], size) < np.repeat(keep, size)]
                sketches = _lists(WORDS * np.arange(hi - lo + 1), sketch.ravel())
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(sig), pa.array(fp.view(np.int64)), pa.array(size, pa.int64()), sketches, _lists(np.concatenate([[0], np.cumsum(keep)]), head)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "sig", "fp", "n", "sketch", "s"])

    return rows.mapInArrow(run, f"id {kind}, sig bigint, fp bigint, n bigint, sketch array<bigint>, s array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(sig, s): each text's whole set."""

    def run(batches):
        for batch in batches:
            for _, _, values, off in shingle_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(off, values)), _lists(off, values)], names=["sig", "s"])

    return texts.mapInArrow(run, "sig bigint, s array<bigint>")


def simhash_candidates(distinct: DataFrame, max_bits: int = BITS) -> DataFrame:
    """(a, b): texts of one fingerprint, and the first texts of fingerprints that the pigeonring search links; ``distinct`` has (sig, fp)."""
    heads = materialize(distinct.groupBy("fp").agg(F.min("sig").alias("head")), "near-prints")
    same = distinct.join(heads, "fp").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    first, second, third = fingerprint_links(heads.select("fp"), max_bits)
    linked = first.unionByName(second).unionByName(third).toDF("fa", "fb")
    linked = linked.join(heads.toDF("fa", "a"), "fa").join(heads.toDF("fb", "b"), "fb").select("a", "b")
    return same.unionByName(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame, *, width: int = 5, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): each document's class; ``similarity`` is a fraction (numerator, denominator)."""
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("similarity must lie above 0 and be 1 at most")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    late = _frequent(rows, width)
    prefixes = materialize(_prefixes(rows.join(late, "id", "left"), width, similarity), "near-prefix")
    named = materialize(prefixes.select("id", "sig"), "near-named")
    folded = materialize(prefixes.groupBy("sig").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("s").alias("s")), "near-folded")
    discard(prefixes, late)
    distinct = materialize(folded.drop("s"), "near-distinct")
    postings = folded.select("sig", "n", F.posexplode("s").alias("at", "key"))
    heads = postings.groupBy("key").agg(F.min("sig").alias("head"), F.max("sig").alias("last")).where("head < last").select("key", "head")
    shared = materialize(postings.join(heads, "key"), "near-shared")
    discard(folded)

    def reaches(n, m, common):
        return common * (num + den) >= (n + m) * num

    n, m, to = F.col("n"), F.col("m"), F.col("to")
    fits = (F.col("key") == F.col("key2")) & reaches(n, m, F.least(n - F.col("at"), m - to))
    apart = sum((F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(WORDS)), F.lit(0))

    def likely(candidates: DataFrame, label: str) -> DataFrame:
        """The candidates whose sketches allow the threshold."""
        pairs = materialize(candidates.select("a", "b").distinct(), f"{label}-pairs")
        left = pairs.join(distinct.select(F.col("sig").alias("a"), "n", F.col("sketch").alias("ka")), "a")
        both = left.join(distinct.select(F.col("sig").alias("b"), n.alias("m"), F.col("sketch").alias("kb")), "b")
        # Sets that differ in d shingles have (n + m - d) / 2 in common.
        return both.where(reaches(n, m, (n + m - apart) / 2)).select("a", "b")

    def links(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs whose whole sets reach the threshold."""
        pairs = materialize(pairs, f"{label}-likely")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        ids = materialize(distinct.join(wanted, "sig", "left_semi").select(F.col("least").alias("id")).distinct(), f"{label}-ids")
        # Rows that share an id are told apart by their set.
        sets = materialize(_sets(rows.join(ids, "id", "left_semi").select("text"), width), f"{label}-sets")
        left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
        out = materialize(both.where(reaches(F.size("sa"), F.size("sb"), common)).select("a", "b").distinct(), label)
        discard(pairs, ids, sets)
        return out

    top = shared.where("sig = head").select(F.col("key").alias("key2"), F.col("sig").alias("b"), n.alias("m"), F.col("at").alias("to"))
    headed = likely(shared.withColumnRenamed("sig", "a").join(top, fits & (F.col("a") != F.col("b"))), "near-first")
    headed = headed.groupBy("a").agg(F.min("b").alias("b"))
    first = links(headed.unionByName(likely(simhash_candidates(distinct), "near-simhash")), "near-first")

    def tagged(found: DataFrame, label: str) -> DataFrame:
        groups = materialize(connected_components(found), f"{label}-groups")
        words = [F.col("sketch")[i].alias(f"k{i}") for i in range(WORDS)]
        nodes = distinct.join(groups, distinct.sig == groups.node, "left").select(F.col("sig").alias("a"), F.coalesce("component", "sig").alias("g"), *words)
        of = shared.withColumnRenamed("sig", "a").join(nodes, "a").select("key", "a", "n", "at", "g", *mine)
        return materialize(of, f"{label}-tagged")

    mine, theirs = ([f"{k}{i}" for i in range(WORDS)] for k in "kl")
    differ = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(j))) for k, j in zip(mine, theirs, strict=True)), F.lit(0))

    def between(texts: DataFrame) -> DataFrame:
        apart_groups = (F.col("a") < F.col("b")) & (F.col("g") != F.col("h"))
        return texts.join(texts.toDF("key2", "b", "m", "to", "h", *theirs), fits & apart_groups & reaches(n, m, (n + m - differ) / 2))

    groups = tagged(first, "near-first")
    one = groups.groupBy("key", "g").agg(F.min(F.struct("a", "n", "at", *mine)).alias("x")).select("key", "x.a", "x.n", "x.at", "g", *(f"x.{k}" for k in mine))
    second = links(likely(between(materialize(one, "near-one")), "near-second"), "near-second")
    discard(groups)
    groups = tagged(first.unionByName(second), "near-second")
    third = links(likely(between(groups), "near-third"), "near-third")
    members = materialize(connected_components(first.unionByName(second).unionByName(third)), "near-members")
    classes = distinct.join(members, distinct.sig == members.node, "left").select("sig", "least", F.coalesce("component", "sig").alias("c"))
    least = classes.join(classes.groupBy("c").agg(F.min("least").alias("component")), "c").select("sig", "component")
    # Written first: the join can split the set of a large group of copies only between plain exchanges.
    out = materialize(named.join(materialize(least, "near-least"), "sig").select("id", "component").distinct(), "near-classes")
    discard(named, distinct, shared, groups, first, second, third)
    return out
