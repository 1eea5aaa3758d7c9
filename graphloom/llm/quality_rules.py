"""Quality rules with risk-controlled thresholds.

Every document gets a few cheap measurements.  A *rule* rejects a document
whose measurement reaches a cutoff; cutoffs are not fixed by hand but selected
per stratum (bands of document length) from labelled documents so that, with
probability at least ``1 - delta`` over the holdout, in no stratum the chosen
rules *together* reject more than ``risk`` of the good documents:

* labelled rows split into a tuning and a holdout half by a hash of the id;
* in each stratum the tuning half lays out a path of rule sets, from lenient
  to strict: first the rules one by one at cutoffs that cost no good tuning
  document, best first, then all of them at ever lower cutoffs.  Each point
  rejects all that the one before it does;
* along the path, the union of the rules is tested on the holdout with the
  exact (Clopper-Pearson) upper bound of its false-rejection rate, and the
  walk stops at the first failure (fixed-sequence testing keeps the path's own
  error);
* the strata share ``delta`` by Bonferroni;
* among the certified points the tuning half picks the one with the best
  balance of bad documents caught and good ones lost; a stratum in which
  nothing is certified, or nothing is gained, abstains.

Only counts per (stratum, rule, grid step, label) and per (stratum, point of
the path, label, half) reach the driver, numbers that do not grow with the
data.

Defined results: a null or empty text has zero words, measures zero, and fails
the base rule; labels without a document, or with null quality, are ignored; a
document with several labels counts once for each; with no labels every rule
abstains; repeated rows are judged alike; clashing extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SHOUT = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_LETTER = ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) | (np.arange(256) >= 128)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shout", "n_lines", "n_echoes")
BANDS = (100, 500)  # words at which a new stratum begins
GRID = 48


def measure_column(column) -> dict[str, np.ndarray]:
    """The integer measurements of each text of an Arrow column."""
    out = {f: np.zeros(len(column), np.int64) for f in FIELDS}
    for lo, hi, buf, off in K.blocks(column):
        starts, ends, words = K.tokens(buf, off, K.SPACE_WORD)
        out["n_words"][lo:hi] = np.diff(words)
        inside = K.SPACE_WORD[buf]
        out["word_chars"][lo:hi] = K.sums_by_text(_LEAD[buf] & inside, off)
        out["n_symbols"][lo:hi] = K.sums_by_text(_SYMBOL[buf], off)
        out["n_upper"][lo:hi] = K.sums_by_text(_UPPER[buf], off)
        out["n_shout"][lo:hi] = K.sums_by_text(_SHOUT[buf], off)
        if not len(starts):
            continue
        sums = K.prefix_sums(buf)
        codes = K.span_hashes(sums, starts, ends)
        echo = np.zeros(len(starts), bool)
        echo[1:] = codes[1:] == codes[:-1]
        echo[words[:-1][np.diff(words) > 0]] = False  # a text's first word follows none
        out["n_echoes"][lo:hi] = K.sums_by_text(echo, words)
        begin = K.inside_windows(words, WINDOW)
        text_of = np.searchsorted(words, begin, side="right").astype(np.uint64)
        keys = K.mix(K.window_hashes(codes, WINDOW)[begin] + text_of * np.uint64(0x9E3779B97F4A7C15))
        hit = K.covered(len(starts), begin[K.repeated(keys)], WINDOW)
        out["n_repeat_words"][lo:hi] = K.sums_by_text(hit, words)
        # Lines: cut at \n and at text ends; only lines with a word count.
        cuts = np.union1d(np.flatnonzero(buf == 10) + 1, off)
        line_start = cuts[:-1]
        line_end = np.where(buf[cuts[1:] - 1] == 10, cuts[1:] - 1, cuts[1:])
        has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[has], line_end[has]
        owner = np.searchsorted(off, line_start, side="right")
        lines = K.mix(K.span_hashes(sums, line_start, line_end) + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(lines, kind="stable")
        later = np.zeros(len(lines), bool)
        later[order[1:]] = lines[order[1:]] == lines[order[:-1]]
        bounds = np.searchsorted(line_start, off)
        out["n_dup_lines"][lo:hi] = K.sums_by_text(later, bounds)
        out["n_lines"][lo:hi] = np.diff(bounds)
    return out


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, measurements, base_failed) for every row, plus the ``keep`` columns."""
    kept = [docs.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            found = measure_column(batch.column(1))
            cols = [batch.column(0), *(pa.array(found[f]) for f in FIELDS), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *FIELDS, *keep])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{f} bigint" for f in FIELDS) + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def rules() -> dict[str, Column]:
    """Rule name to a measurement in [0, 1]; a document is rejected from a cutoff on."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    size = {
        "symbols": F.col("n_symbols") / chars,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "echoes": F.col("n_echoes") / words,
        "capitals": F.col("n_upper") / chars,
        "shouting": F.col("n_shout") / words,
        "short_words": 1 / (1 + F.col("word_chars") / words / 5),
        "long_words": 1 - 1 / (1 + F.col("word_chars") / words / 20),
    }
    return {k: F.least(F.lit(1.0), v) for k, v in size.items()}


def stratum() -> Column:
    out = F.lit(len(BANDS))
    for i, upto in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < upto, F.lit(i)).otherwise(out)
    return out


def grid_step(value: Column) -> Column:
    """Square-root spacing: finer steps near zero, where most cutoffs lie."""
    return F.floor(F.sqrt(value) * GRID).cast("int")


def upper_bound(failures: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate under which so few failures have probability ``level``."""
    if n == 0 or failures >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(failures + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = failures / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(min(max(mid, 1e-12), 1 - 1e-12)) > level else (lo, mid)
    return hi


@dataclass(frozen=True)
class Cutoffs:
    """The rules of a stratum: a document goes if a rule's grid step reaches the rule's own."""

    stratum: int
    steps: dict[str, int]
    holdout_good: int
    holdout_rejected: int
    bound: float


LEVELS = 32  # cutoffs of a path that differ in the good documents they may cost


def cutoff_path(counts: dict[str, np.ndarray], *, risk: float, price: float) -> list[dict[str, int]]:
    """Rule sets from lenient to strict; ``counts`` has the tuning documents by [good, step] for every rule."""
    curves = {}
    for rule, c in sorted(counts.items()):
        bad, good = c[:, ::-1].cumsum(axis=1)[:, ::-1]  # documents rejected at each step
        curves[rule] = (bad - price * good, good / max(1, good[0]))

    def best(rule: str, loss: float) -> int:
        gain, lost = curves[rule]
        allowed = [k for k in range(1, GRID + 1) if lost[k] <= loss]
        return max(allowed, key=lambda k: (gain[k], k), default=GRID + 1)

    free = {r: best(r, 0.0) for r in curves}
    ranked = sorted((r for r, k in free.items() if k <= GRID and curves[r][0][k] > 0), key=lambda r: (-curves[r][0][free[r]], r))
    path = [{r: free[r] for r in ranked[: i + 1]} for i in range(len(ranked))]
    for level in range(1, LEVELS + 1):
        steps = {r: best(r, risk * level / LEVELS) for r in curves}
        path.append({r: k for r, k in steps.items() if k <= GRID and curves[r][0][k] > 0})
    return [p for i, p in enumerate(path) if p and p not in path[:i]]


def first_points(path: list[dict[str, int]], rule: str) -> list[int]:
    """For every grid step of the rule, the first point of the path at which the rule rejects it."""
    return [next((i for i, p in enumerate(path) if p.get(rule, GRID + 1) <= step), len(path)) for step in range(GRID + 1)]


def certify(band: int, path: list[dict[str, int]], counts: np.ndarray, *, risk: float, level: float, price: float) -> Cutoffs | None:
    """The best certified point; ``counts`` has the documents by [half, good, first point that rejects them], half 0 tunes."""
    upto = counts.cumsum(axis=-1)
    n = int(counts[1, 1].sum())
    certified = []
    for i, steps in enumerate(path):
        failures = int(upto[1, 1, i])
        bound = upper_bound(failures, n, level)
        if bound > risk:
            break
        certified.append((upto[0, 0, i] - price * upto[0, 1, i], -i, Cutoffs(band, steps, n, failures, bound)))
    if not certified:
        return None
    gain, _, found = max(certified, key=lambda x: x[:2])
    return found if gain > 0 else None


def fit_cutoffs(labelled: DataFrame, *, risk: float = 0.05, delta: float = 0.05, price: float = 10.0) -> list[Cutoffs]:
    """Cutoffs from measured rows with ``quality`` (1 good, 0 bad)."""
    half = F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")
    usable = labelled.where("quality in (0, 1) and not base_failed")
    steps = usable.select(stratum().alias("band"), F.col("quality").cast("int").alias("quality"), half, *(grid_step(v).alias(k) for k, v in rules().items()))
    each = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("step")) for k in rules()))
    tuning: dict[int, dict[str, np.ndarray]] = {}
    for x in steps.where("half = 0").select("band", "quality", F.explode(each).alias("r")).groupBy("band", "quality", "r.rule", "r.step").count().collect():
        tuning.setdefault(x["band"], {}).setdefault(x["rule"], np.zeros((2, GRID + 1), np.int64))[x["quality"], x["step"]] += x["count"]
    paths = {band: cutoff_path(counts, risk=risk, price=price) for band, counts in tuning.items()}
    paths = {band: path for band, path in paths.items() if path}
    if not paths:
        return []
    point = F.lit(None).cast("int")
    for band, path in sorted(paths.items()):
        reached = [F.element_at(F.array(*(F.lit(i) for i in first_points(path, k))), F.col(k) + 1) for k in rules()]
        point = F.when(F.col("band") == band, F.least(*reached)).otherwise(point)
    found = {band: np.zeros((2, 2, len(path) + 1), np.int64) for band, path in paths.items()}
    for x in steps.select("band", "half", "quality", point.alias("point")).where("point is not null").groupBy("band", "half", "quality", "point").count().collect():
        found[x["band"]][x["half"], x["quality"], x["point"]] += x["count"]
    level = delta / (len(BANDS) + 1)
    chosen = [certify(band, paths[band], found[band], risk=risk, level=level, price=price) for band in sorted(paths)]
    return [c for c in chosen if c is not None]


def rejected(cutoffs: list[Cutoffs]) -> Column:
    measures, out = rules(), F.lit(False)
    for c in cutoffs:
        for rule, step in sorted(c.steps.items()):
            out = out | ((stratum() == c.stratum) & (grid_step(measures[rule]) >= step))
    return out


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> tuple[DataFrame, list[Cutoffs]]:
    """Measurements of every document (written once, texts left out) and the cutoffs.

    ``labels`` has the id and ``quality``.
    """
    marks = labels.where("quality in (0, 1)").select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
    measured = materialize(measure(docs, id_col=id_col, text_col=text_col), "quality")
    return measured, fit_cutoffs(measured.join(marks, "id"), **limits)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Measurements, ``base_failed`` and ``kept`` for every document."""
    measured, cutoffs = learn(docs, labels, id_col=id_col, text_col=text_col, **limits)
    return measured.withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, with their own columns.

    The second pass measures again beside the text instead of shuffling texts
    to meet their verdicts.
    """
    measured, cutoffs = learn(docs, labels, id_col=id_col, text_col=text_col, **limits)
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    found = measure(inner, id_col=at[id_col], text_col=at[text_col], keep=tuple(inner.columns))
    discard(measured)
    return found.where(~F.col("base_failed") & ~rejected(cutoffs)).select(*(F.col(at[n]).alias(n) for n in names))
