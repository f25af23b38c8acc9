"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains (combinations of its labels). With n_i
tokens, posterior p_i and a rate r_i >= 0 for document i, the expected share of domain d is x_d = sum_i r_i n_i p_id / B, where B
is the budget in tokens. Projected gradient descent with momentum minimises

    1/2 sum_d (x_d - w_d)^2 / m_d  +  MU/2 sum_i (n_i / B) (r_i - budget)^2

where m_d is the share at rate 1; in the metric n_i / B the step 1 / (1 + MU) is safe. The momentum starts anew whenever a step raises the
objective. A step needs only the K numbers x_d, one grouped sum over all documents; a document's rate is a fold over the K-number
gradients since the rates were last written, every KEEP steps. It ends when every share is within NEAR of its target, or
when the objective has not fallen by SETTLED of itself in KEEP steps (targets that no rates reach); if STEPS come first, there is
a warning. Targets, shares reached and steps come with the rates. The copies of a document are its rate rounded down, or up if
a hash of its doc_id falls below the fraction.

Defined results: null and empty texts have no tokens and get rate and copies by their posterior like others; domains with no
labelled rows get no posterior and the remaining targets are scaled to one; no labelled rows or no tokens at all: every rate is
the budget; repeated rows get the same rate each; an empty table gives an empty table. A posterior is a softmax of
log-probabilities, so that it is a number however unlikely all domains are. Tokens are runs of [^\\x20\\x09-\\x0D].
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PAUSE, appended, everything, fresh, settled, used, written
from .linear import SAMPLE, Features, Sample, logistic

MU, NEAR, SETTLED, KEEP, STEPS = 1e-3, 0.01, 1e-4, 8, 400
#: Domains are quality and toxic labels together; shares of tokens wanted of each.
TARGETS = {"good": 0.96, "low": 0.03, "good_toxic": 0.005, "low_toxic": 0.005}


def _domain() -> F.Column:
    return F.concat(F.when(F.col("quality") == 1, "good").otherwise("low"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))


def softmax_of_logistic(z: np.ndarray) -> np.ndarray:
    """One-vs-rest probabilities of scores z, scaled to one in each row; never 0 / 0."""
    log = -np.logaddexp(0, -z)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, labels: DataFrame, targets: dict[str, float], size: int = SAMPLE) -> tuple[DataFrame, list[str], list[str]]:
    """All columns of docs with a count of words and an array of posteriors; the domains; the names of the two columns."""
    known = labels.where("quality is not null and toxic is not null").select("doc_id", _domain().alias("domain"))
    s = Sample(docs, known, ["domain"], size)
    domains = [d for d in targets if (s.rows["domain"] == d).any()]
    features = Features(s.choose([F.col("domain") == d for d in domains]))
    x = s.matrix(features)
    weights = np.stack([logistic(x, (s.rows["domain"] == d).to_numpy(float)) for d in domains], axis=1) if domains else np.zeros((features.width, 1))
    used(s.table)
    sent = docs.sparkSession.sparkContext.broadcast((list(features.at), weights))
    ready: list[Features] = []

    def run(texts: list[str | None]) -> tuple[list, list]:
        if not ready:
            ready.append(Features(sent.value[0]))
        p = softmax_of_logistic(ready[0].of_texts(texts) @ sent.value[1])
        return [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], np.round(p, 6).tolist()

    names = fresh(docs, "n_tokens__", "p__")
    return appended(docs, ["text"], run, **dict(zip(names, ("long", "array<double>"), strict=True))), domains or ["all"], names


@dataclass
class Fit:
    """Steps as (gradient, momentum, whether the momentum starts anew after it), and for each domain its target and the share reached."""

    steps: list[tuple[list[float], float, bool]]
    targets: dict[str, float]
    shares: dict[str, float]

    def rates(self, p: np.ndarray, budget: float) -> np.ndarray:
        """The rates of posteriors (rows, domains): what the steps make of them, in one pass."""
        r = y = np.full(len(p), float(budget))
        for g, momentum, anew in self.steps:
            new = np.maximum(0.0, y - (p @ np.array(g) + MU * (y - budget)) / (1 + MU))
            y = new if anew else new + momentum * (new - r)
            r = new
        return r


def moved(gradients: list[tuple[list[float], float]], budget: float, p: str, rate: str, ahead: str) -> tuple[F.Column, F.Column]:
    """(rate, point of the next gradient) after steps of (gradient, momentum) from the written ones."""
    if not gradients:
        return F.col(rate), F.col(ahead)
    step = 1 / (1 + MU)
    steps = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in g]).alias("g"), F.lit(float(b)).alias("b")) for g, b in gradients])

    def one(s: F.Column, x: F.Column) -> F.Column:
        pull = F.aggregate(F.zip_with(x["g"], F.col(p), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        r = F.greatest(F.lit(0.0), s["y"] - step * (pull + MU * (s["y"] - budget)))
        return F.struct(r.alias("r"), (r + x["b"] * (r - s["r"])).alias("y"))

    end = F.aggregate(steps, F.struct(F.col(rate).cast("double").alias("r"), F.col(ahead).cast("double").alias("y")), one)
    return end["r"], end["y"]


def fit_rates(weighed: DataFrame, domains: list[str], targets: dict[str, float], budget: float = 1.0, names: tuple[str, str] = ("n_tokens__", "p__")) -> Fit:
    """weighed: counts and posteriors under `names`."""
    tokens, p = names
    k = len(domains)
    want = np.array([targets.get(d, 1.0) for d in domains])
    want = want / want.sum() * budget
    rate, ahead = fresh(weighed, "rate__", "ahead__")

    def sums(rows: DataFrame, *rates: F.Column) -> list[tuple[np.ndarray, float]]:
        """For each column of rates the K sums of rate * tokens * posterior, and that of tokens * (rate - budget)^2."""
        made = rows.select(F.col(tokens).alias("n"), F.col(p).alias("p"), *[r.alias(f"r{i}") for i, r in enumerate(rates)])
        got = made.agg(*[c for i in range(len(rates)) for c in (*[F.sum(F.col(f"r{i}") * F.col("n") * F.get("p", F.lit(j))) for j in range(k)], F.sum(F.col("n") * F.pow(F.col(f"r{i}") - budget, F.lit(2))))]).first()
        values = [float(v or 0) for v in got]
        return [(np.array(values[i : i + k]), values[i + k]) for i in range(0, len(values), k + 1)]

    now = weighed.select(tokens, p).withColumns({rate: F.lit(float(budget)), ahead: F.lit(float(budget))})
    mass, _ = sums(weighed, F.lit(1.0))[0]
    total = float(weighed.agg(F.sum(tokens)).first()[0] or 0)
    if total <= 0:
        return Fit([], dict(zip(domains, want.tolist(), strict=True)), dict.fromkeys(domains, 0.0))
    natural = np.maximum(mass / total, 1e-6)
    gradients: list[tuple[list[float], float]] = []
    steps: list[tuple[list[float], float, bool]] = []
    x, y, t, values, kept = natural * budget, natural * budget, 1.0, [], None
    while True:
        if np.abs(x - want).max() <= 0 or (np.abs(x - want) <= NEAR * want).all():
            break
        if len(values) > KEEP and values[-1 - KEEP] - values[-1] <= SETTLED * values[-1 - KEEP]:
            break
        if len(steps) >= STEPS:
            warnings.warn(f"mixing: {STEPS} steps end at shares {dict(zip(domains, np.round(x, 6), strict=True))} for targets {dict(zip(domains, np.round(want, 6), strict=True))}", stacklevel=2)
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        gradients.append((((y - want) / natural).tolist(), (t - 1) / after))
        r, a = moved(gradients, budget, p, rate, ahead)
        settled(now.sparkSession, PAUSE)  # each step is a plan of its own
        (x, gap), (y, _) = ((s / total, g / total) for s, g in sums(now, r, a))
        values.append(float(((x - want) ** 2 / natural).sum() / 2 + MU / 2 * gap))
        t, rises = after, len(values) > 1 and values[-1] > values[-2]
        steps.append((*gradients[-1], rises))
        if rises or len(gradients) >= KEEP:
            if rises:  # go on from the rate itself
                t, y, a = 1.0, x, r
            last, now = kept, written(now.withColumns({rate: r, ahead: a}), "rates")
            kept, gradients = now, []
            if last is not None:
                used(last)
    if kept is not None:
        used(kept)
    return Fit(steps, dict(zip(domains, want.tolist(), strict=True)), dict(zip(domains, x.tolist(), strict=True)))


def rated(weighed: DataFrame, fit: Fit, budget: float, p: str) -> tuple[DataFrame, str]:
    """weighed and a column of rates; its name."""
    name, = fresh(weighed, "rate__")
    run = lambda ps: (np.round(fit.rates(np.array(ps, float), budget), 6).tolist(),)
    return appended(weighed, [p], run, **{name: "double"}), name


def copies(rate: F.Column, seed: int = 17) -> F.Column:
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 32)).cast("double") / float(1 << 32)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, domain (the likeliest), rate, copies, and the domain's target and the share reached."""
    targets = targets or TARGETS
    weighed, domains, _ = posteriors(docs.select("doc_id", "text"), labels, targets)
    weighed = written(weighed.drop("text"), "weighed")
    fit = fit_rates(weighed, domains, targets, budget)
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.array_position("p__", F.array_max("p__")).cast("int") - 1)
    rows, rate = rated(weighed, fit, budget, "p__")
    rows = rows.select("doc_id", F.col("n_tokens__").alias("n_tokens"), of(domains).alias("domain"), F.col(rate).alias("rate"), of([round(v, 6) for v in fit.targets.values()]).alias("target_share"), of([round(v, 6) for v in fit.shares.values()]).alias("reached_share"))
    return rows.withColumn("copies", copies(F.col("rate")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its copies say, with their columns."""
    targets = targets or TARGETS
    weighed, domains, names = posteriors(docs, labels, targets)
    weighed = written(weighed, "weighed")
    rows, rate = rated(weighed, fit_rates(weighed, domains, targets, budget, tuple(names)), budget, names[1])
    times, copy = fresh(rows, "copies__", "copy__")
    rows = rows.withColumn(times, copies(F.col(rate))).where(F.col(times) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*everything(docs))
