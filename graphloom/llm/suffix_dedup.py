"""Exact byte dedup over a logarithmic family of suffix arrays.

Texts are UTF-8 bytes.  A byte goes if a string of ``min_bytes`` bytes that
covers it also starts earlier: in a document of smaller id, or earlier in the
same document.  Strings are judged on the input.

The candidate suffixes (see ``repeats``; a bucket holds all suffixes of its
anchors) arrive in document order and are indexed by the logarithmic method.
Each new batch gets a suffix array: the places of its suffixes in the
lexicographic order of their first ``min_bytes`` bytes, which is all of the
order that matters for matches that long.  The array is merge-scanned against
every existing level; suffixes that match in all these bytes, in a level or
earlier in the batch, are repeats.  What is new forms a level, and levels of
like size merge, so a bucket of n suffixes keeps O(log n) levels and each
suffix is merged O(log n) times.  Equality is always that of the bytes.

``StoredFamily`` keeps a family between batches of documents: its levels are
tables of anchored suffixes in key order, with their texts.  A new batch is
merge-scanned against every level by key, what it meets joins the search, and
levels of like size merge, so a corpus of n documents keeps O(log n) tables.

Defined results: null and empty texts have no bytes; rows that share an id but
not a text are documents of their own, in the order of a hash of the text;
rows equal in id and text count as one document and get the same result; rows
without an id come last and keep the null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize
from .repeats import ROW, buckets, context_blocks, find_anchors, identified, named, range_lists, repeated_ranges, shapes, with_ranges

#: Bytes of contexts in a bucket and of sorted suffixes in a batch, at windows of 100 bytes.
BUCKET_BYTES, BATCH_BYTES = 512 << 10, 4 << 20


class SuffixArray:
    """Suffixes in lexicographic order of their first ``width`` bytes.

    ``heads`` are these bytes, ascending and distinct; ``places`` say where
    (in the order of arrival) each suffix starts first.
    """

    def __init__(self, heads: np.ndarray, places: np.ndarray):
        self.heads, self.places = heads, places

    @classmethod
    def build(cls, heads: np.ndarray, places: np.ndarray) -> tuple[SuffixArray, np.ndarray]:
        """The array of a batch in document order, and for each suffix its index in it."""
        order = np.argsort(heads, kind="stable")  # equal suffixes stay in document order
        ranked = heads[order]
        first = np.ones(len(heads), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        index = np.empty(len(heads), np.int64)
        index[order] = np.cumsum(first) - 1
        return cls(ranked[first], places[order[first]]), index

    def __len__(self):
        return len(self.heads)

    def scan(self, other: SuffixArray) -> np.ndarray:
        """Mask over ``other``'s suffixes: this array holds them.  Both are sorted, so the search walks forward."""
        at = np.minimum(np.searchsorted(self.heads, other.heads), len(self) - 1)
        return self.heads[at] == other.heads

    def part(self, mask: np.ndarray) -> SuffixArray:
        return SuffixArray(self.heads[mask], self.places[mask])

    def merged(self, other: SuffixArray) -> SuffixArray:
        heads, places = np.concatenate([self.heads, other.heads]), np.concatenate([self.places, other.places])
        order = np.argsort(heads, kind="stable")  # merges two sorted runs
        return SuffixArray(heads[order], places[order])


class IndexFamily:
    """Levels of suffix arrays over different suffixes; level sizes fall geometrically."""

    def __init__(self):
        self.levels: list[SuffixArray] = []
        self.seen = 0

    def add(self, heads: np.ndarray) -> np.ndarray:
        """Indexes a batch in document order; mask of the suffixes that start earlier."""
        if not len(heads):
            return np.zeros(0, bool)
        batch, index = SuffixArray.build(heads, self.seen + np.arange(len(heads)))
        known = np.zeros(len(batch), bool)
        for level in self.levels:
            known |= level.scan(batch)
        repeat = np.ones(len(heads), bool)
        repeat[batch.places[~known] - self.seen] = False
        self.seen += len(heads)
        self._insert(batch.part(~known))
        return repeat

    def _insert(self, level: SuffixArray) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self.levels.pop().merged(level)
        if len(level):
            self.levels.append(level)


def heads_of(buf: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes at each place, as strings that sort by bytes."""
    if not len(begin):
        return np.zeros(0, f"S{width}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, width)[begin]).view(f"S{width}").ravel()


def family_index(batches, width: int, gram: int):
    family = IndexFamily()
    for new, part in buckets(batches):
        if new:
            family = IndexFamily()
        _, n, _ = shapes(part)
        step = np.cumsum(n) * width // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = part.slice(a, b - a)
            buf, off = context_blocks(piece)
            yield piece, family.add(heads_of(buf, K.inside_windows(off, width), width))


def _gram(min_bytes: int) -> int:
    if min_bytes < 16:
        raise ValueError("min_bytes must be at least 16")
    return max(8, min(20, min_bytes // 4))


def repeated_bytes(rows: DataFrame, *, min_bytes: int = 100, runs: DataFrame | None = None) -> DataFrame:
    """(row names, s, e): stretches of bytes inside strings of ``min_bytes`` that start earlier, of identified rows."""
    size = max(1, BUCKET_BYTES * 100 // max(100, min_bytes))
    return repeated_ranges(rows, width=min_bytes, gram=_gram(min_bytes), words=False, earlier_only=True, index=family_index, order=(*ROW, "at"), bucket_bytes=size, runs=runs)


class StoredFamily:
    """An index family in a folder of shared storage, for documents that come in batches.

    The folder holds levels (``runs`` in key order, ``texts``) and numbered
    manifests; the last whole manifest counts, so an interrupted batch leaves
    the family as it was.
    """

    def __init__(self, spark: SparkSession, home: str, min_bytes: int = 100):
        self.spark, self.home, self.min_bytes = spark, home.rstrip("/"), min_bytes
        self.levels: list[tuple[str, int]] = []  # (folder, runs), the largest first
        self.batches = 0
        found = self._manifests()
        if found:
            rows = spark.read.parquet(f"{self.home}/manifest-{found[-1]}").orderBy("place").collect()
            if rows[0]["min_bytes"] != min_bytes:
                raise ValueError(f"the family was built for strings of {rows[0]['min_bytes']} bytes")
            self.batches, self.levels = found[-1], [(r["folder"], r["runs"]) for r in rows]

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        fs, path = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n[9:]) for n in names if n.startswith("manifest-")]
        return sorted(n for n in numbers if fs.exists(self._folder(f"manifest-{n}/_SUCCESS")[1]))

    def _read(self, part: str) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.home}/{folder}/{part}") for folder, _ in self.levels]

    def _write(self, runs: list[DataFrame], texts: list[DataFrame]) -> tuple[str, int]:
        folder = f"level-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, runs).orderBy("key").write.parquet(f"{self.home}/{folder}/runs")
        reduce(DataFrame.unionByName, texts).write.parquet(f"{self.home}/{folder}/texts")
        return folder, self.spark.read.parquet(f"{self.home}/{folder}/runs").count()

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Indexes a batch: (its identified rows, their stretches of bytes that start earlier in it or in any batch before)."""
        batch = self.batches + 1
        rows = materialize(identified(docs, id_col, text_col, batch=batch), "batch")
        own = find_anchors(rows, self.min_bytes, _gram(self.min_bytes), False)
        fresh = self._write([own], [rows])
        mine = self.spark.read.parquet(f"{self.home}/{fresh[0]}/runs")
        keys = materialize(mine.select("key").distinct(), "batch-keys")
        met = materialize(reduce(DataFrame.unionByName, [level.join(keys, "key", "left_semi") for level in self._read("runs")], mine), "batch-runs")
        texts = reduce(DataFrame.unionByName, self._read("texts"), rows)
        found = repeated_bytes(texts, min_bytes=self.min_bytes, runs=met).where(F.col("batch") == batch)
        self.levels.append(fresh)
        merged: set[str] = set()
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            parts = [[self.spark.read.parquet(f"{self.home}/{folder}/{part}") for folder, _ in self.levels[-2:]] for part in ("runs", "texts")]
            merged.update(folder for folder, _ in self.levels[-2:])
            self.levels[-2:] = [self._write(*parts)]
        entries = [(i, folder, runs, self.min_bytes) for i, (folder, runs) in enumerate(self.levels)]
        self.spark.createDataFrame(entries, "place int, folder string, runs bigint, min_bytes int").coalesce(1).write.parquet(f"{self.home}/manifest-{batch}")
        self.batches = batch
        for folder in sorted(merged):
            fs, path = self._folder(folder)
            fs.delete(path, True)
        return rows, found


def digest(docs: DataFrame, *, min_bytes: int = 100, id_col: str = "doc_id", text_col: str = "text", family: StoredFamily | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) after removing every repeated byte.

    With a family, strings of its earlier batches count as earlier, and the
    documents join it.
    """
    if family is None:
        rows = identified(docs, id_col, text_col)
        found = repeated_bytes(rows, min_bytes=min_bytes)
    else:
        rows, found = family.add(docs, id_col=id_col, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    met = with_ranges(rows, found)
    met = met.select(named(met), "text", "ranges")

    def run(batches):
        for batch in batches:
            lists = range_lists(batch.column(2))
            size, removed, spans, sha = [], [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), lists, strict=True):
                raw = (text or "").encode()
                h, at = hashlib.sha256(), 0
                for s, e in gone:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                size.append(len(raw))
                removed.append(sum(e - s for s, e in gone))
                spans.append(len(gone))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
