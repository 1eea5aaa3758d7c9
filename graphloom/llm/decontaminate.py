"""Benchmark decontamination with a broadcast hash set of test n-grams.

A benchmark item's *windows* are its runs of ``n`` consecutive normalised
words (an item with fewer words is one window of its own length).  Document
words inside an occurrence of any window are hit.

The windows' 64-bit hashes are sorted once and broadcast in blocks of at most
``block_bytes`` of benchmark text; the usual benchmark is one block.  A larger
one is scanned block after block, so what a worker holds is bounded whatever
the benchmark's size.  A document's window that meets a hash is verified word
by word against the block's own bytes before it counts.

Defined results: null texts have no words; an item without words has no
window; repeated items and documents are judged alike; rows with a null
item_id still mark words but are not named; an empty benchmark hits nothing;
clashing extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


class Windows:
    """The distinct windows of a block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list, texts: list, n: int):
        self.n = n
        buf, off = K.raw_bytes(pa.array(texts, pa.large_string()))
        buf, off = K.LOWER[buf[off[0] : off[-1]]], off - off[0]
        starts, ends, words = K.tokens(buf, off, K.ALNUM_WORD)
        codes = K.span_hashes(K.prefix_sums(buf), starts, ends)
        self.names = sorted({str(i) for i in ids if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        self.bytes, self.by_length = buf, {}
        count = np.diff(words)
        for length in sorted({min(int(c), n) for c in count if c}):
            rows = np.flatnonzero(count >= n) if length == n else np.flatnonzero(count == length)
            begin = np.concatenate([np.arange(words[r], words[r + 1] - length + 1) for r in rows])
            owner = np.concatenate([np.full(count[r] - length + 1, place.get(str(ids[r]), -1) if ids[r] is not None else -1) for r in rows])
            keys = K.mix(K.window_hashes(codes, length)[begin])
            order = np.argsort(keys, kind="stable")
            keys, begin, owner = keys[order], begin[order], owner[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            bounds = np.append(np.flatnonzero(first), len(keys))
            sample = begin[bounds[:-1]]
            self.by_length[length] = (keys[bounds[:-1]], bounds, owner, [self._words(buf, starts, ends, b, length) for b in sample])

    @staticmethod
    def _words(buf, starts, ends, at: int, length: int) -> bytes:
        return b" ".join(buf[starts[i] : ends[i]].tobytes() for i in range(at, at + length))

    def scan(self, buf, off):
        """(token starts, ends, offsets by text, hit mask, [(text, item place)])."""
        buf = K.LOWER[buf]
        starts, ends, words = K.tokens(buf, off, K.ALNUM_WORD)
        hit = np.zeros(len(starts), bool)
        found: set[tuple[int, int]] = set()
        if len(starts) and self.by_length:
            codes = K.span_hashes(K.prefix_sums(buf), starts, ends)
            for length, (keys, bounds, owner, exact) in self.by_length.items():
                begin = K.inside_windows(words, length)
                if not len(begin):
                    continue
                mine = K.mix(K.window_hashes(codes, length)[begin])
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                meets = np.flatnonzero(keys[at] == mine)
                where, at = begin[meets], at[meets]
                true = np.array([self._words(buf, starts, ends, b, length) == exact[a] for b, a in zip(where.tolist(), at.tolist(), strict=True)], bool)
                where, at = where[true], at[true]
                hit |= K.covered(len(starts), where, length)
                text = np.searchsorted(words, where, side="right") - 1
                for t, a in set(zip(text.tolist(), at.tolist(), strict=True)):
                    found.update((t, int(o)) for o in owner[bounds[a] : bounds[a + 1]] if o >= 0)
        return starts, ends, words, hit, found


def benchmark_blocks(items: DataFrame, n: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Windows]:
    """Windows of the benchmark in blocks of bounded size, one block in the driver at a time."""
    ids, texts, size, any_block = [], [], 0, False
    for row in items.where(F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_bytes:
            yield Windows(ids, texts, n)
            ids, texts, size, any_block = [], [], 0, True
    if texts or not any_block:
        yield Windows(ids, texts, n)


def scan_documents(
    docs: DataFrame, items: DataFrame, *, n: int = 10, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", action: str = "report", drop_share: float = 0.5
) -> DataFrame:
    """What the benchmark's windows hit in each document.

    ``action``:
      * ``report``: (id, n_words, n_hit, spans ARRAY<BIGINT>, items ARRAY<STRING>); a span is two
        byte offsets, begin and end in turn, of hit words in the UTF-8 text.
      * ``clean``: the documents' own columns; hit spans are cut from the text
        and a document of which at least ``drop_share`` of the words is hit goes.
    """
    spark = docs.sparkSession
    sets = [spark.sparkContext.broadcast(w) for w in benchmark_blocks(items, n, block_bytes, item_col, item_text)]
    several = len(sets) > 1
    names = docs.columns
    at_text = names.index(text_col)

    def scan(column):
        """Yields (row, number of words, hit words, spans, items)."""
        for lo, hi, buf, off in K.blocks(column, K.BLOCK_BYTES * (16 if several else 1)):
            hit, found = None, [set() for _ in range(hi - lo)]
            for shared in sets:
                block = shared.value
                if several:  # a worker holds one block at a time
                    del shared._value
                starts, ends, words, more, named = block.scan(buf, off)
                hit = more if hit is None else hit | more
                for t, k in named:
                    found[t].add(block.names[k])
            total = K.sums_by_text(hit, words)
            for t in range(hi - lo):
                spans: list[int] = []
                if total[t]:
                    mask = np.zeros(words[t + 1] - words[t] + 2, np.int8)
                    mask[1:-1] = hit[words[t] : words[t + 1]]
                    turn = np.diff(mask)
                    begin, end = np.flatnonzero(turn == 1) + words[t], np.flatnonzero(turn == -1) - 1 + words[t]
                    spans = np.stack([starts[begin], ends[end]], axis=1).ravel() - off[t]
                    spans = spans.tolist()
                yield lo + t, int(words[t + 1] - words[t]), int(total[t]), spans, sorted(found[t])

    def report(batches):
        for batch in batches:
            rows = list(scan(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.string()))],
                names=["id", "n_words", "n_hit", "spans", "items"],
            )

    def clean(batches):
        for batch in batches:
            column = K.text_array(batch.column(at_text))
            texts, stay = {}, np.ones(batch.num_rows, bool)
            for row, n_words, n_hit, spans, _ in scan(batch.column(at_text)):
                if n_hit:
                    stay[row] = n_hit < drop_share * n_words
                    raw = column[row].as_py().encode()
                    cut = [0, *spans, len(raw)]
                    texts[row] = b"".join(raw[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)).decode()
            arrays = list(batch.columns)
            if texts:
                old = batch.column(at_text).to_pylist()
                for row, text in texts.items():
                    old[row] = text
                arrays[at_text] = pa.array(old, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).filter(pa.array(stay))

    if action == "clean":
        return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(clean, _schema(docs)).toDF(*names)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(report, f"id {kind}, n_words bigint, n_hit bigint, spans array<bigint>, items array<string>")


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
