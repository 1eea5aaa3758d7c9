"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are the character bigrams and trigrams of the lower-cased text (runs
of non-letters count as one space), hashed to ``2 ** BITS`` bins; a bin's
value is its share of the text's n-grams times its inverse document frequency.
Document frequencies are counted over every training document.  The weights
are learned by follow-the-regularised-leader with an elastic net (the L1 part
keeps them sparse), on at most ``per_class`` training documents a language
(expected number, chosen by a hash of id and text).  A fifth of that sample is
left out of the fit and calibrates one temperature by negative log-likelihood.
Every language with a training document is learned; the model is languages
times bins, and more than ``MAX_CLASSES`` languages raise an error.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the language first in name order; without training documents
every text is ``und``; null labels are never learned; repeated rows are scored
alike; clashing extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS = 15
ORDERS = (2, 3)
MAX_CLASSES = 2048
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bins of every n-gram, offsets by text): whole texts, end to end."""
    low = [" " + t.lower() + " " if t else "" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, low), np.int64, len(low))
    owner_off = np.concatenate([[0], np.cumsum(length)])
    codes = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[owner_off[:-1][length > 0]] = True
    run = np.concatenate([[0], np.cumsum(keep)])
    codes, off = codes[keep], run[owner_off]
    parts, counts = [], np.maximum(np.diff(off)[:, None] - (np.array(ORDERS) - 1), 0)
    for order in ORDERS:
        h = codes[: len(codes) - order + 1] if len(codes) >= order else codes[:0]
        h = h * np.uint32(0x9E3779B1) + np.uint32(order)
        for k in range(1, order):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[k : len(codes) - order + 1 + k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        parts.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    bins = np.empty(int(counts.sum()), np.int32)
    out_off = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    at = out_off[:-1].copy()
    for j, order in enumerate(ORDERS):
        begin = K.inside_windows(off, order)
        n = counts[:, j]
        place = np.arange(len(begin)) + np.repeat(at - (np.cumsum(n) - n), n)
        bins[place] = parts[j][begin]
        at += n
    return bins, out_off


def _text_blocks(column, limit: int = 1 << 19):
    texts = column.to_pylist()
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield lo, i + 1, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents of every bin, over all of ``docs``, and their number."""
    size = 1 << BITS

    def run(batches):
        df, n = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for _, _, texts in _text_blocks(batch.column(0)):
                bins, off = grams(texts)
                for a, b in zip(off[:-1], off[1:], strict=True):
                    seen = np.zeros(size, bool)
                    seen[bins[a:b]] = True
                    df[:-1] += seen
                n += len(texts)
        df[-1] = n
        bins = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(df[bins])], names=["bin", "n"])

    rows = docs.select(text_col).mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in rows:
        df[r["bin"]] = r["n"]
    return df[:-1], int(df[-1])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # [class, bin]: inverse document frequency times weight
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        bins, off = grams(texts)
        n = np.diff(off)
        out = np.tile(self.bias, (len(texts), 1))
        live = np.flatnonzero(n)
        if len(live):
            for k in range(len(self.labels)):
                out[live, k] += np.add.reduceat(self.weights[k][bins], off[:-1][live], dtype=np.float64) / n[live]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = np.fromiter((bool(t) and _LETTER.search(t) is not None for t in texts), bool, len(texts))
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if y else "und" for b, y in zip(best, ok, strict=True)], np.where(ok, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression; rows are (bins, values, class). Weights [bin, class], bias."""
    z, s = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(zb, sb):
        w = -(zb - np.sign(zb) * l1) / ((beta + np.sqrt(sb)) / alpha + l2)
        w[np.abs(zb) <= l1] = 0.0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bins, values, y = rows[i]
            zb, sb = z[bins], s[bins]
            w = weights(zb, sb)
            p = softmax(values @ w)
            p[y] -= 1.0
            g = values[:, None] * p
            z[bins] += g - (np.sqrt(sb + g * g) - np.sqrt(sb)) / alpha * w
            s[bins] += g * g
    w = weights(z, s)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(u):
        p = softmax(logits / np.exp(u))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


SCALE = 50.0  # shares of n-grams are small; one constant for all documents


def train(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = 1000, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> Model:
    """Learns from the rows for which ``usable`` holds and the label is known."""
    pool = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = pool.groupBy(label_col).count().orderBy(label_col).limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages in {label_col}")
    labels = sorted(r[0] for r in sizes)
    if not labels:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(docs.where(usable), text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    chance = F.lit(0.0)
    for r in sizes:
        chance = F.when(F.col(label_col) == r[0], F.lit(min(1.0, per_class / r["count"]))).otherwise(chance)
    kind = docs.schema[label_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, texts in _text_blocks(batch.column(0)):
                bins, off = grams(texts)
                found = [np.unique(bins[a:b], return_counts=True) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64())), batch.column(2).slice(lo, hi - lo)],
                    names=["label", "bins", "counts", "draw"],
                )

    sample = pool.where(draw < chance).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col, text_col).alias("draw"))
    got = sample.mapInArrow(run, f"label {kind}, bins array<int>, counts array<bigint>, draw bigint").orderBy("draw").limit(2 * per_class * len(labels)).collect()
    place = {v: k for k, v in enumerate(labels)}
    rows, rest = [], []
    for r in got:
        bins, counts = np.array(r["bins"], np.int64), np.array(r["counts"], float)
        if len(bins):
            row = (np.append(bins, 1 << BITS), np.append(SCALE * counts / counts.sum() * idf[bins], 1.0), place[r["label"]])
            (rest if r["draw"] % 5 == 0 else rows).append(row)
    w, bias = ftrl(rows, len(labels), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    model = Model(labels, np.ascontiguousarray((SCALE * idf[:, None] * w).T.astype(np.float32)), bias, 1.0)
    full = np.vstack([w, bias])
    logits = np.array([v @ full[b] for b, v, _ in rest]).reshape(-1, len(labels))
    model.temperature = fit_temperature(logits, np.array([y for _, _, y in rest], int))
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row.  The model is fixed in size: classes times bins."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = [], []
            for _, _, texts in _text_blocks(batch.column(1)):
                found, p = shared.value.predict(texts)
                names += found
                scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
