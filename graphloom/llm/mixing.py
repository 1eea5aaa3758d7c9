"""Mixing a corpus to target domain weights with soft memberships, in SQL only.

A classifier learned from a table of labelled documents predicts, for every
document, posterior probabilities over the domains; the documents' rates
(expected copies, nonnegative) are then fitted by projected-gradient least
squares so that each domain's expected tokens meet its target.

* Classifier: multinomial naive Bayes over words hashed to ``BINS`` bins.  It
  learns from at most ``per_domain`` labelled documents a domain (expected
  number, chosen by a hash of the id); a fifth of that sample is left out of
  the counts and calibrates how strongly the mean evidence of a word weighs
  against the prior.  Labelled documents of domains without a target form one
  class more, ``None``, so that they are not taken for a target's.  Scoring
  explodes the words beside the scan, meets the broadcast table of bins (at
  most ``BINS`` rows of one number per class) and sums by row, combined on the
  map side; only one row a document is shuffled.
* Fit: with tokens n, posteriors p and rates r, the residual of domain k is
  (sum of n p_k r) / t_k - 1, weighted by t_k / s_k where s_k is the domain's
  size at rate one, which makes the problem well conditioned.  The class
  without a target has the target zero.  A step moves r against its gradient
  in the token-weighted metric and clips at zero.  The rates need no state
  between steps: they are a fixed expression over the posteriors and the
  history of residuals (a vector of one number per domain), so an iteration is
  one aggregate over the posteriors and nothing else is shuffled, kept or lost
  with an executor.

Everything runs in DataFrame operations.  The driver only sees per-domain
numbers; more than ``MAX_DOMAINS`` targets raise an error.

Defined results: null and empty texts have zero tokens and the prior
posterior; without labelled rows of a target there are no domains and every
rate is 1; target weights of domains that no labelled row has are dropped and
the rest renormalised; documents with several labels count for each; an empty
table gives an empty result; repeated rows and rows without an id are scored
alike; extra columns, clashing names included, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BINS = 1 << 14
MAX_DOMAINS = 64
#: White space between words.
GAPS = r"[\x20\x09-\x0D]+"
#: Candidate weights of the mean evidence of a word.
WEIGHTS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
SEED = 5


def words(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, bin): a row for every word of every text; white space at its ends, or a text without words, gives null bins."""
    each = F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), GAPS)).alias("word")
    return rows.select(*keep, each).select(*keep, F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BINS)).cast("int")).alias("bin"))


def labelled_sample(docs: DataFrame, marks: DataFrame, per_domain: int) -> DataFrame:
    """(domain, text, held) of a bounded sample of the labelled documents; ``marks`` has (id, domain), ``docs`` (id, text)."""
    sizes = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    chance = F.lit(0)
    for domain, n in sorted(sizes.items(), key=lambda x: x[0] or ""):
        same = F.col("domain").isNull() if domain is None else F.col("domain") == domain
        chance = F.when(same, F.lit(math.ceil(min(1.0, per_domain / n) * (1 << 30)))).otherwise(chance)
    chosen = marks.where(draw < chance).withColumn("held", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(5)) == 0)
    return docs.join(F.broadcast(chosen), "id").select("domain", "text", "held")  # bounded by per_domain


def fit_table(sample: DataFrame, domains: list[str | None], smoothing: float = 0.1) -> tuple[DataFrame, list[float], list[float]]:
    """(bin table (bin, e0, e1, ...), default evidence of each class, log priors) from (domain, text)."""
    at = F.lit(None).cast("int")
    for k, d in enumerate(domains):
        at = F.when(F.col("domain").isNull() if d is None else F.col("domain") == d, F.lit(k)).otherwise(at)
    rows = sample.withColumn("k", at)
    size = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    counts = words(rows, "k").where("bin is not null").groupBy("bin").agg(*(F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(domains))))
    counts = materialize(counts, "mix-bins")
    total = counts.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains)))).first()
    mass = [(total[k] or 0) + smoothing * BINS for k in range(len(domains))]
    table = counts.select("bin", *(F.log((F.col(f"n{k}") + smoothing) / mass[k]).alias(f"e{k}") for k in range(len(domains))))
    everything = sum(size.get(k, 0) for k in range(len(domains)))
    prior = [math.log((size.get(k, 0) + 1) / (everything + len(domains))) for k in range(len(domains))]
    return table, [math.log(smoothing / m) for m in mass], prior


def evidence(rows: DataFrame, table: DataFrame, default: list[float], *keep: str) -> DataFrame:
    """(keep, n_tokens, e): the words of every row and the mean evidence of a word for each class."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())  # rows may share an id
    met = words(numbered, "_row", *keep).join(F.broadcast(table), "bin", "left")  # at most BINS rows
    sums = [F.sum(F.when(F.col("bin").isNotNull(), F.coalesce(f"e{k}", F.lit(d)))).alias(f"s{k}") for k, d in enumerate(default)]
    found = met.groupBy("_row", *keep).agg(F.count("bin").cast("double").alias("n_tokens"), *sums)
    means = [F.coalesce(F.col(f"s{k}") / F.col("n_tokens"), F.lit(0.0)) for k in range(len(default))]
    return found.select(*keep, "n_tokens", F.array(*means).alias("e"))


def posterior(prior: list[float], weight: float) -> Column:
    """Posterior of each class from a row's evidence ``e``."""
    scores = F.array(*(F.lit(p) + F.lit(weight) * F.col("e")[k] for k, p in enumerate(prior)))
    top = F.array_max(scores)
    odds = [F.exp(scores[k] - top) for k in range(len(prior))]
    whole = reduce(lambda a, b: a + b, odds)
    return F.array(*(o / whole for o in odds))


def _own_posteriors(scored: DataFrame, domains: list[str | None], prior: list[float]) -> DataFrame:
    """(w0, w1, ...): the ``posterior`` of each row's own domain at each weight.

    Step by step: as one expression each class would repeat the scores of all,
    and plans of thousands of nodes cost the driver's memory.
    """
    each, of = range(len(WEIGHTS)), range(len(prior))
    rows = scored.select("domain", *(F.array(*(F.lit(p) + F.lit(w) * F.col("e")[k] for k, p in enumerate(prior))).alias(f"s{i}") for i, w in enumerate(WEIGHTS)))
    rows = rows.select("*", *(F.array_max(f"s{i}").alias(f"t{i}") for i in each))
    rows = rows.select("domain", *(F.array(*(F.exp(F.col(f"s{i}")[k] - F.col(f"t{i}")) for k in of)).alias(f"o{i}") for i in each))
    at = F.lit(None).cast("int")
    for k, d in enumerate(domains):
        at = F.when(F.col("domain").isNull() if d is None else F.col("domain") == d, F.lit(k)).otherwise(at)
    rows = rows.select(at.alias("k"), *(f"o{i}" for i in each))
    return rows.select(*((F.col(f"o{i}")[F.col("k")] / reduce(lambda a, b: a + b, (F.col(f"o{i}")[k] for k in of))).alias(f"w{i}") for i in each))


def calibrate(scored: DataFrame, domains: list[str | None], prior: list[float]) -> float:
    """The weight of least negative log-likelihood over scored rows (domain, e)."""
    losses = [F.avg(-F.log(F.greatest(f"w{i}", F.lit(1e-12)))).alias(f"w{i}") for i in range(len(WEIGHTS))]
    row = _own_posteriors(scored, domains, prior).agg(*losses).first()
    found = [(x, -i) for i, x in enumerate(row) if x is not None]
    return WEIGHTS[-min(found)[1]] if found else WEIGHTS[2]


def rate_expression(history: list[list[float]], step: float, start: float) -> Column:
    """The rate after the steps whose weighted residuals are in ``history``."""
    rate = F.lit(float(start))
    for residual in history:
        moved = reduce(lambda a, b: a + b, (F.col("p")[k] * F.lit(float(g)) for k, g in enumerate(residual)))
        rate = F.greatest(F.lit(0.0), rate - F.lit(float(step)) * moved)
    return rate


def fit_rates(mixed: DataFrame, targets: list[float], *, budget: float | None = None, steps: int = 25, tolerance: float = 1e-4) -> tuple[Column, list[float]]:
    """The rate column and each domain's expected share at those rates."""
    k_all = range(len(targets))
    sums = lambda rate: mixed.agg(*(F.sum(F.col("n_tokens") * F.col("p")[k] * rate) for k in k_all)).first()
    at_one = [float(x or 0.0) for x in sums(F.lit(1.0))]
    whole = sum(at_one)
    if whole <= 0:
        return F.lit(1.0), [0.0] * len(targets)
    tokens = budget if budget is not None else whole
    goal = [t * tokens for t in targets]
    # Gradient in the token metric with weights 1 / s_k; its largest eigenvalue is
    # at most 1, since (n p p') has row sums s_k.
    history: list[list[float]] = []
    reached = at_one
    for _ in range(steps):
        gap = [(reached[k] - goal[k]) / at_one[k] if at_one[k] > 0 else 0.0 for k in k_all]
        if max(abs(reached[k] - goal[k]) for k in k_all) <= tolerance * tokens:
            break
        history.append(gap)
        reached = [float(x or 0.0) for x in sums(rate_expression(history, 1.0, 1.0))]
    made = sum(reached) or 1.0
    return rate_expression(history, 1.0, 1.0), [x / made for x in reached]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, steps: int = 25, per_domain: int = 4000) -> DataFrame:
    """(id, n_tokens, p, domains, rate, n_copies, shares) for every row.

    ``labelled`` has the id and ``domain``; ``weights`` gives each domain's
    target share.  ``p`` follows ``domains``, whose last, null, stands for
    domains without a target where labelled rows have such.  ``n_copies``
    rounds the rate up or down by a hash of the id, so that its expectation is
    the rate and a rerun repeats it.  ``shares`` are the shares of the domains'
    expected tokens that the rates reach, alike in all rows.
    """
    wanted = sorted(d for d in weights if weights[d] > 0)
    if len(wanted) > MAX_DOMAINS:
        raise ValueError(f"{len(wanted)} target domains; at most {MAX_DOMAINS} can be fitted")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    target = F.col("domain").isin(wanted) if wanted else F.lit(False)
    marks = labelled.where(F.col("domain").isNotNull()).select(F.col(id_col).alias("id"), F.when(target, F.col("domain")).alias("domain")).where(F.col("id").isNotNull()).distinct()
    known = {r[0] for r in marks.select("domain").distinct().collect()}
    domains: list[str | None] = [d for d in wanted if d in known]
    if not domains:
        found = words(rows.withColumn("_row", F.monotonically_increasing_id()), "_row", "id").groupBy("_row", "id").agg(F.count("bin").cast("double").alias("n_tokens"))
        none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("p", "double"), ("domains", "string"))]
        return found.select("id", "n_tokens", *none, F.lit(1.0).alias("rate"), F.lit(1).alias("n_copies"), F.array().cast("array<double>").alias("shares"))
    total = sum(weights[d] for d in domains)
    goals = [weights[d] / total for d in domains]
    if None in known:
        domains, goals = [*domains, None], [*goals, 0.0]
    sample = labelled_sample(rows, marks, per_domain)
    table, default, prior = fit_table(sample.where("not held"), domains)
    weight = calibrate(evidence(sample.where("held"), table, default, "domain"), domains, prior)
    scored = evidence(rows, table, default, "id").select("id", "n_tokens", posterior(prior, weight).alias("p"))
    mixed = materialize(scored, "mix-p")
    rate, shares = fit_rates(mixed, goals, budget=budget, steps=steps)
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = mixed.withColumn("rate", rate).withColumn("domains", F.array(*(F.lit(d) for d in domains)).cast("array<string>"))
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("int")).cast("int").alias("n_copies")
    return out.select("id", "n_tokens", "p", "domains", "rate", copies, F.array(*(F.lit(float(x)) for x in shares)).alias("shares"))
