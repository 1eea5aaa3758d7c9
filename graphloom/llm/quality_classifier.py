"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else, labelled or
not, is unlabelled web text.  A small network on dense text statistics is
trained to minimise the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss, so that its sigmoid estimates the probability of a
good document.  The class prior ``pi`` is estimated, not given: for a score
that separates positives from the rest, the ratio of the unlabelled to the
positive share above a cutoff bounds the prior from above, and the smallest
such ratio (each share widened by its confidence term) is the estimate.  It
starts from a classifier of positives against unlabelled rows and is refined
once with the trained network's own scores.

The statistics of every text are computed once and written (some thirty
floats a document); the fit takes at most ``max_rows`` positives and as many
unlabelled rows, chosen by a hash of the id.

Defined results: null and empty texts have zero statistics and get the
model's score for them; with no positives every score is the neutral 0.5;
labels of unknown documents are ignored; repeated rows are scored alike;
clashing extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

_KINDS = ["lower", "upper", "digit", "space", "line", "other", "lead", "tail"] + list(".,!?;:'\"#*$%&|<>@=_-/()")


def _byte_kinds() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = _KINDS.index("lead")
        elif b >= 0x80:
            out[b] = _KINDS.index("tail")
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c == "\n":
            out[b] = _KINDS.index("line")
        elif c.isspace():
            out[b] = _KINDS.index("space")
        elif c in _KINDS:
            out[b] = _KINDS.index(c)
    return out


_KIND = _byte_kinds()
_UPPER = _KIND == 1
WIDTH = len(_KINDS) + 8


def statistics(column) -> np.ndarray:
    """[text, WIDTH] float32 statistics, each in a small fixed range."""
    out = np.zeros((len(column), WIDTH), np.float32)
    for lo, hi, buf, off in K.blocks(column):
        size = np.maximum(np.diff(off), 1)
        owner = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(off))
        kinds = np.bincount(owner * len(_KINDS) + _KIND[buf], minlength=(hi - lo) * len(_KINDS)).reshape(hi - lo, -1)
        part = out[lo:hi]
        part[:, : len(_KINDS)] = np.sqrt(kinds / size[:, None])
        starts, ends, words = K.tokens(buf, off, K.SPACE_WORD)
        if not len(starts):
            continue
        codes = K.span_hashes(K.prefix_sums(buf), starts, ends)
        count = np.diff(words)
        some = np.maximum(count, 1)
        echo = np.zeros(len(starts), bool)
        echo[1:] = codes[1:] == codes[:-1]
        echo[words[:-1][count > 0]] = False
        second = np.minimum(starts + 1, len(buf) - 1)
        shout = _UPPER[buf[starts]] & _UPPER[buf[second]] & (ends - starts > 1)
        of = np.repeat(np.arange(hi - lo, dtype=np.uint64), count)
        keys = np.sort(K.mix(codes + of * np.uint64(0x9E3779B97F4A7C15)))
        text_keys = np.ones(len(keys), bool)
        text_keys[1:] = keys[1:] != keys[:-1]
        begin = K.inside_windows(words, 8)
        eight = K.mix(K.window_hashes(codes, 8)[begin] + np.searchsorted(words, begin, side="right").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = K.covered(len(starts), begin[K.repeated(eight)], 8)
        long = ends - starts
        base = len(_KINDS)
        part[:, base] = np.log1p(count) / 10
        part[:, base + 1] = K.sums_by_text(long, words) / some / 10
        part[:, base + 2] = K.sums_by_text(echo, words) / some
        part[:, base + 3] = K.sums_by_text(shout, words) / some
        part[:, base + 4] = K.sums_by_text(again, words) / some
        part[:, base + 5] = K.sums_by_text(long > 20, words) / some
        part[:, base + 6] = K.sums_by_text(long <= 2, words) / some
        order = np.lexsort((codes, of))
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (of[order][1:] != of[order][:-1])
        part[:, base + 7] = K.sums_by_text(fresh, words) / some
    return out


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x BINARY): the statistics of every row as float32."""

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x binary")


@dataclass
class Network:
    """One tanh layer; inputs are standardised."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x.astype(np.float64)), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Smallest ratio of unlabelled to positive mass above a score cutoff, with confidence terms."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    up = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    uu = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((uu + slack) / np.maximum(up, 1e-9)))
    return float(np.clip(uu[best] / max(up[best], 1e-9), 0.02, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, *, hidden: int = 24, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the non-negative risk; ``prior`` None fits plain positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    net = Network(both.mean(axis=0), both.std(axis=0) + 0.02, rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    params = ["w1", "b1", "w2", "b2"]
    m, v, t = {p: 0.0 for p in params}, {p: 0.0 for p in params}, 0
    sp, su = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        step_rate = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        rows_p = rng.permutation(len(sp))
        rows_u = rng.permutation(len(su))
        for k in range(max(1, len(su) // batch)):
            xu = su[rows_u[k * batch : (k + 1) * batch]]
            xp = sp[rows_p[np.arange(k * batch, k * batch + batch) % len(sp)]]
            x = np.vstack([xp, xu])
            h = np.tanh(x @ net.w1 + net.b1)
            g = h @ net.w2 + net.b2
            s, n_p = sigmoid(g), len(xp)
            d = np.empty(len(x))
            if prior is None:
                d[:n_p], d[n_p:] = (s[:n_p] - 1) / n_p, s[n_p:] / len(xu)
            else:
                rest = np.logaddexp(0, g[n_p:]).mean() - prior * np.logaddexp(0, g[:n_p]).mean()
                if rest >= 0:
                    d[:n_p], d[n_p:] = prior * (s[:n_p] - 1 - s[:n_p]) / n_p, s[n_p:] / len(xu)
                else:  # the negative part went below zero: step back from it
                    d[:n_p], d[n_p:] = prior * s[:n_p] / n_p, -s[n_p:] / len(xu)
            back = (d[:, None] * net.w2) * (1 - h * h)
            grads = {"w1": x.T @ back + decay * net.w1, "b1": back.sum(axis=0), "w2": h.T @ d + decay * net.w2, "b2": d.sum()}
            t += 1
            for p in params:
                m[p] = 0.9 * m[p] + 0.1 * grads[p]
                v[p] = 0.999 * v[p] + 0.001 * grads[p] ** 2
                setattr(net, p, getattr(net, p) - step_rate * (m[p] / (1 - 0.9**t)) / (np.sqrt(v[p] / (1 - 0.999**t)) + 1e-8))
    return net


def train(features: DataFrame, labels: DataFrame, usable: Column, *, max_rows: int = 8000, seed: int = 3) -> tuple[Network | None, float]:
    """(network, prior) from statistics ``features`` and ``labels`` (id, quality)."""
    order = F.xxhash64("id", F.lit(seed))
    good = labels.where("quality = 1").select("id").distinct()
    pool = features.where(usable & F.col("id").isNotNull())
    pick = lambda df: np.array([np.frombuffer(r[0], np.float32) for r in df.orderBy(order, "id").limit(max_rows).select("x").collect()], float).reshape(-1, WIDTH)
    positive, unlabelled = pick(pool.join(good, "id", "left_semi")), pick(pool)
    if not len(positive) or not len(unlabelled):
        return None, 0.5
    first = fit_nnpu(positive, unlabelled, None, seed=seed)
    prior = estimate_prior(first.raw(positive), first.raw(unlabelled))
    net = fit_nnpu(positive, unlabelled, prior, seed=seed)
    prior = estimate_prior(net.raw(positive), net.raw(unlabelled))
    return fit_nnpu(positive, unlabelled, prior, seed=seed), prior


def score_documents(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """(id, score) for every row; ``usable`` (over column id) says which rows may be learned from."""
    features = materialize(measured(docs, id_col=id_col, text_col=text_col), "quality-x")
    net, _ = train(features, labels.select(F.col(id_col).alias("id"), "quality"), usable, **fit)

    def run(batches):
        for batch in batches:
            x = np.array([np.frombuffer(b, np.float32) for b in batch.column(1).to_pylist()]).reshape(-1, WIDTH)
            score = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return features.mapInArrow(run, f"id {kind}, score double")
