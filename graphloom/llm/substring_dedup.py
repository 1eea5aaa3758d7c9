"""Substring dedup over prefix-partitioned suffix trees.

The suffixes that begin at anchors (see ``repeats``; every window holds one)
are split by their first words, a prefix that grows for the few prefixes whose
group would outgrow a task.  Suffixes whose prefix is unique cannot repeat and
never form a group.  Each memory-sized set of groups becomes a sparse suffix
tree, held as its sorted leaves and the depth of the common prefix of
neighbours: an internal node is a maximal stretch of leaves that agree to its
depth.  A second tree of the same leaves reads backwards from the anchors.  A
window that begins j words before its anchor repeats if another leaf lies
below the same node at depth ``min_words`` - j of the one tree and at depth j
of the other; such leaves share a repeat of at least ``min_words`` words, and
a repeat is maximal where the nodes are no deeper on either side.

The trees' letters are the words themselves, numbered within the bucket by
their bytes; nothing is decided by a hash of a window.

Defined results: null and empty texts have no words; a text shorter than a
window has none; copies (texts or whole rows) repeat each other, so all their
windows go; rows that share an id but not a text, and rows without an id, are
documents of their own; an empty table gives an empty result; extra columns,
clashing names included, are kept as they are by ``drop_repeats`` and ignored
otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import ROW, context_blocks, identified, named, range_lists, repeated_ranges, shapes, whole_buckets, with_ranges

#: Bytes of contexts in a bucket.
BUCKET_BYTES = 4 << 20


class SuffixTree:
    """The suffix tree of some letter sequences, cut at the sequences' length.

    ``leaves`` sorts the rows of ``letters``; ``depth[i]`` is how many letters
    leaf i and its predecessor share.  The nodes at depth d are the stretches
    of depth >= d.
    """

    def __init__(self, letters: np.ndarray):
        self.leaves = np.lexsort(letters.T[::-1]) if letters.shape[1] else np.arange(len(letters))
        ranked = letters[self.leaves]
        self.depth = np.zeros(len(letters), np.int64)
        self.depth[1:] = np.logical_and.accumulate(ranked[1:] == ranked[:-1], axis=1).sum(axis=1)

    def nodes(self, depth: int) -> np.ndarray:
        """Of every leaf, the number of its ancestor at this depth."""
        out = np.empty(len(self.leaves), np.int64)
        out[self.leaves] = np.cumsum(self.depth < depth)
        return out


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(int(off[-1]), dtype=np.int64) + np.repeat(starts - off[:-1], size)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(buf[source])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def around(codes: np.ndarray, off: np.ndarray, anchor: np.ndarray, size: int, back: bool) -> np.ndarray:
    """The letters from each anchor on, or before it backwards; -1 beyond the sequence."""
    at = anchor[:, None] + (-1 - np.arange(size) if back else np.arange(size))
    inside = (at >= off[:-1, None]) & (at < off[1:, None])
    return np.where(inside, codes[np.clip(at, 0, max(len(codes) - 1, 0))], -1)


def repeated_windows(codes: np.ndarray, off: np.ndarray, n: np.ndarray, place: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Mask over the windows of all contexts, each context's in order: it occurs in another context too."""
    window_off = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(window_off[-1]), bool)
    anchor = off[:-1] + place
    onward, backward = SuffixTree(around(codes, off, anchor, width, False)), SuffixTree(around(codes, off, anchor, width - gram, True))
    for j in range(width - gram + 1):
        here = np.flatnonzero((place - n < j) & (j <= place))
        if len(here) > 1:
            pair = onward.nodes(width - j)[here] * (len(n) + 1) + backward.nodes(j)[here]
            out[window_off[here] + place[here] - j] = K.repeated(pair)
    return out


def tree_index(batches, width: int, gram: int):
    for part in whole_buckets(batches):
        buf, off = context_blocks(part)
        starts, ends, count = K.tokens(buf, off, K.SPACE_WORD)
        _, n, place = shapes(part)
        yield part, repeated_windows(word_numbers(buf, starts, ends), count, n, place, width, gram)


def repeated_words(rows: DataFrame, *, min_words: int = 35) -> DataFrame:
    """(row names, s, e): stretches of words inside windows of ``min_words`` that occur elsewhere, of identified rows."""
    if min_words < 10:
        raise ValueError("min_words must be at least 10")
    gram = max(3, min(8, min_words // 3))
    return repeated_ranges(rows, width=min_words, gram=gram, words=True, earlier_only=False, index=tree_index, order=(*ROW, "at"), bucket_bytes=BUCKET_BYTES)


def digest(docs: DataFrame, *, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) after removing every repeated word."""
    rows = identified(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    met = with_ranges(rows, repeated_words(rows, min_words=min_words))
    met = met.select(named(met), "text", "ranges")

    def run(batches):
        for batch in batches:
            lists = range_lists(batch.column(2))
            total, removed, sha = [], [], []
            for lo, hi, buf, off in K.blocks(batch.column(1)):
                raw = buf.tobytes()
                for t in range(hi - lo):
                    words = raw[off[t] : off[t + 1]].split()
                    if _EXTRA.intersection(raw[off[t] : off[t + 1]]):  # bytes that split() takes for white space
                        words = _words(buf[off[t] : off[t + 1]])
                    gone, at, kept = 0, 0, []
                    for s, e in lists[lo + t]:
                        kept += words[at:s]
                        gone += e - s
                        at = e
                    kept += words[at:]
                    total.append(len(words))
                    removed.append(gone)
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    return met.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


#: bytes.split() cuts at the same bytes as ``[\x20\x09-\x0D]``; none are extra.
_EXTRA: frozenset[int] = frozenset(b for b in range(256) if bytes([b]).isspace() != (not K.SPACE_WORD[b]))


def _words(buf: np.ndarray) -> list[bytes]:
    starts, ends, _ = K.tokens(buf, np.array([0, len(buf)]), K.SPACE_WORD)
    return [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def drop_repeats(docs: DataFrame, *, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated words cut out of their texts.

    The bytes from a removed stretch's first word up to the next kept word go;
    the rest of the text, its spacing included, stays.  A document of which no
    word is left goes; one that had no word stays.
    """
    names, at_text = docs.columns, docs.columns.index(text_col)
    columns = [f"c{i}" for i in range(len(names))]
    inner = docs.toDF(*columns)
    rows = identified(inner, columns[names.index(id_col)], columns[at_text], *columns)
    met = with_ranges(rows, repeated_words(rows.select(*ROW, "text"), min_words=min_words)).select(*columns, "ranges")

    def run(batches):
        for batch in batches:
            lists = range_lists(batch.column(len(columns)))
            texts = batch.column(at_text).to_pylist()
            stay = np.ones(batch.num_rows, bool)
            for i, spans in enumerate(lists):
                if not spans or texts[i] is None:
                    continue
                raw = texts[i].encode()
                starts, _, _ = K.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.SPACE_WORD)
                ends = np.append(starts, len(raw))
                parts, at = [], 0
                for s, e in spans:
                    parts.append(raw[at : ends[s]])
                    at = ends[e]
                left = b"".join([*parts, raw[at:]])
                stay[i] = bool(left.strip())
                texts[i] = left.decode()
            arrays = list(batch.columns[: len(columns)])
            arrays[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(stay))

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema.fields, strict=True))
    return met.mapInArrow(run, schema).toDF(*names)
