r"""Quality rules with robust multivariate outliers.

Each text gives base counts and a vector of transformed statistics. For each (lang, source) a minimum-covariance-determinant
estimate is found over all its documents that pass the base rules: from each of three starts (medians with interquartile ranges,
means with covariances, medians with the covariance of directions) two concentration steps are taken, and from the one with
the smallest determinant as many more as it takes until no determinant falls by TOLERANCE any more. A concentration step takes the share
H of the documents with the smallest Mahalanobis distances and estimates mean and covariance from them. Distances are counted in
buckets of 1/64 octave, with the moments of each bucket, so a step is one grouped sum, combined before the shuffle; the bucket
in which H is reached is taken whole. No group has to fit in one task.

Small groups say little about a covariance, so each estimate has PRIOR rows' weight of the estimate one level up: a source's
of its language's, a language's of that of all documents. The statistics are not normal either: lengths are skewed and most texts
repeat nothing. So the covariance gets the squared FLOOR of each statistic added, a spread that is normal for clean prose.
Documents are rejected beyond the squared distance that a normal document exceeds with a chance of TAIL.

Defined results: null text has no words and fails the base rules; null lang and source are groups of their own, apart from the
languages and from all; a group without documents that pass the base rules has no estimate and no document to judge; repeated
rows count each; an empty table gives an empty table; only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import appended, mapped, used, written

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
STATS = ("x0", "x1", "x2", "x3", "x4")
WIDTH = len(STATS)
FLOOR = (1.0, 0.12, 0.03, 0.12, 0.12)
H, PRIOR, TOLERANCE, TAIL = 0.75, 300, 1e-3, 1e-11
_STARTS = 3


def chi_square_tail(x: float, degrees: int) -> float:
    """P(chi-square > x) for odd degrees of freedom."""
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, degrees, 2):
        out += term
        term *= x / (k + 2)
    return out


def chi_square_quantile(tail: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_tail(mid, degrees) > tail else (lo, mid)
    return hi


CUT = chi_square_quantile(TAIL, WIDTH)
#: The smallest share H of a normal sample has a smaller covariance than the whole, by this factor.
_CONSISTENT = H / (1 - chi_square_tail(chi_square_quantile(1 - H, WIDTH), WIDTH + 2))


def base_counts(texts: list[str | None]) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    rows = []
    for first, encoded in textkit.blocks(texts):
        words = textkit.Words(encoded, lower=False)
        runs = textkit.windows(words.hashes(), 3)
        points = np.concatenate(([0], np.cumsum(((words.buf & 0xC0) != 0x80) & ~textkit._SPACE[words.buf])))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[words.buf])))
        for k, (a, b, s, e) in enumerate(zip(words.first, words.last, words.text_start, words.text_end, strict=True)):
            n, repeated = int(b - a), 0
            if n > 3:
                _, back, times = np.unique(runs[a : b - 2], return_inverse=True, return_counts=True)
                if len(times) < n - 2:
                    twice = times[back] > 1
                    mark = np.zeros(n, bool)
                    for j in range(3):
                        mark[j : j + n - 2] |= twice
                    repeated = int(mark.sum())
            text, dup = texts[first + k] or "", 0
            if "\n" in text:
                dup = sum(c - 1 for line, c in Counter(text.split("\n")).items() if c > 1 and line.strip(" \t\n\r\x0b\x0c"))
            rows.append((n, int(points[e] - points[s]), int(symbols[e] - symbols[s]), dup, repeated))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")


def _counted(texts: list[str | None]) -> list[list[int]]:
    out = base_counts(texts)
    return [*(out[c].tolist() for c in out.columns), [(t or "").count("\n") + 1 for t in texts]]


def statistics() -> list[Column]:
    """The vector: log words, log word length, and the square roots of the shares of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.col("n_lines").cast("double")), F.sqrt(F.col("n_repeat_words") / n)]


_PAIRS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
_PLACE = "g string, start int, n double, mean array<double>, second array<double>, inverse array<double>, det double"


def _square(upper: np.ndarray) -> np.ndarray:
    c = np.zeros((WIDTH, WIDTH))
    c[np.triu_indices(WIDTH)] = upper
    return c + np.triu(c, 1).T


def _finished(n: float, s: np.ndarray, p: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums of n rows and of their products (upper triangle) -> mean, mean products, inverse of the covariance, log determinant."""
    if prior is not None:
        n, s, p = n + PRIOR, s + PRIOR * prior[0], p + PRIOR * prior[1]
    m, second = s / n, p / n
    c = (_square(second) - np.outer(m, m)) * _CONSISTENT + np.diag(np.square(FLOOR))
    return m, second, np.linalg.inv(c), float(np.linalg.slogdet(c)[1])


def _prior(mean: object, second: object) -> tuple[np.ndarray, np.ndarray] | None:
    return None if mean is None or second is None else (np.asarray(mean, float), np.asarray(second, float))


def _begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each group, from medians, spreads, moments and the products of directions."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            prior = _prior(r.prior_mean, r.prior_second)
            middle, spread = np.asarray(r.middle, float), np.asarray(r.spread, float)
            ways = [
                (middle, np.diag(np.square(spread))),
                (np.asarray(r.s, float) / r.n, _square(np.asarray(r.p, float) / r.n) - np.outer(np.asarray(r.s, float), np.asarray(r.s, float)) / r.n**2),
                (middle, WIDTH * _square(np.asarray(r.u, float) / r.n) * np.outer(spread, spread)),
            ]
            for k, (m, c) in enumerate(ways):
                _, _, inverse, _ = _finished(r.n, r.n * m, r.n * (c + np.outer(m, m))[np.triu_indices(WIDTH)], prior)
                out.append((r.g, k, float(r.n), m, None, inverse.ravel(), math.inf))
        yield pd.DataFrame(out, columns=["g", "start", "n", "mean", "second", "inverse", "det"])


def _concentrated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets of a group, with the moments of each -> the estimate from the nearest share H. A bounded row for each group and start."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            rows = sorted(r.buckets, key=lambda b: b["bucket"])
            n = np.array([b["n"] for b in rows], float)
            take = int(np.searchsorted(np.cumsum(n), H * n.sum() - 1e-9)) + 1
            s, p = (np.array([b[c] for b in rows[:take]], float).sum(axis=0) for c in ("s", "p"))
            m, second, inverse, det = _finished(n[:take].sum(), s, p, _prior(r.prior_mean, r.prior_second))
            out.append((r.g, int(r.start), float(n.sum()), m, second, inverse.ravel(), det))
        yield pd.DataFrame(out, columns=["g", "start", "n", "mean", "second", "inverse", "det"])


def _distance(x: str, mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance, written out."""
    d = [F.col(f"{x}{i}") - F.get(mean, F.lit(i)) for i in range(WIDTH)]
    return sum((d[i] * d[j] * F.get(inverse, F.lit(i * WIDTH + j)) for i in range(WIDTH) for j in range(WIDTH)), F.lit(0.0))


def _moments(z: list[Column]) -> list[Column]:
    return [F.sum(z[i] * z[j]) for i, j in _PAIRS]


def estimates(stats: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """stats(g, x0..x4) -> g, n, mean, second, inverse, det: the estimate of each group g. priors: g, prior_mean, prior_second."""
    if priors is None:
        priors = stats.select("g").limit(0).select("g", F.lit(None).cast("array<double>").alias("prior_mean"), F.lit(None).cast("array<double>").alias("prior_second"))
    x = [F.col(c) for c in STATS]
    middle = stats.groupBy("g").agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in STATS])
    spread = [F.sqrt(F.pow((F.get(c, F.lit(2)) - F.get(c, F.lit(0))) / 1.349, F.lit(2)) + f * f) for c, f in zip(STATS, FLOOR, strict=True)]
    middle = written(middle.select("g", F.array(*[F.get(c, F.lit(1)) for c in STATS]).alias("middle"), F.array(*spread).alias("spread")), "middle")
    z = [(x[i] - F.get("middle", F.lit(i))) / F.get("spread", F.lit(i)) for i in range(WIDTH)]
    size = F.greatest(sum((c * c for c in z), F.lit(0.0)), F.lit(1e-12))
    sums = stats.join(middle, "g").groupBy("g").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*_moments(x)).alias("p"), F.array(*[F.sum(z[i] * z[j] / size) for i, j in _PAIRS]).alias("u"))
    starts = sums.join(middle, "g").join(priors, "g", "left").select("g", "n", "s", "p", "u", "middle", "spread", "prior_mean", "prior_second")
    now = written(mapped(starts, _begun, _PLACE), "estimate")
    used(middle)

    def step(now: DataFrame) -> DataFrame:
        far = stats.join(now.select("g", "start", "mean", "inverse"), "g").select("g", "start", *STATS, F.floor(64 * F.log2(1 + F.greatest(_distance("x", "mean", "inverse"), F.lit(0.0)))).cast("int").alias("bucket"))
        held = far.groupBy("g", "start", "bucket").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*_moments(x)).alias("p"))
        groups = held.groupBy("g", "start").agg(F.collect_list(F.struct("bucket", "n", "s", "p")).alias("buckets"))  # some thousand buckets at most
        return mapped(groups.join(priors, "g", "left").select("g", "start", "buckets", "prior_mean", "prior_second"), _concentrated, _PLACE)

    for _ in range(2):
        last, now = now, written(step(now), "estimate")
        used(last)
    best = now.groupBy("g").agg(F.min(F.struct("det", "start")).alias("b")).select("g", "b.start")
    last, now = now, written(now.join(best, ["g", "start"]), "estimate")
    used(last)
    done = None
    while True:  # each further step lowers a determinant, which is bounded below, by TOLERANCE
        new = written(step(now), "estimate")
        falls = new.select("g", F.col("det").alias("d2")).join(now.select("g", "det"), "g").where(F.col("d2") < F.col("det") - TOLERANCE).select("g")
        going, still = written(new.join(falls, "g", "left_semi"), "estimate"), written(now.join(falls, "g", "left_anti"), "estimate")
        used(new, now)
        done = still if done is None else done.unionByName(still)
        now = going
        if now.isEmpty():
            return done.drop("start")


def _prior_of(parents: DataFrame, own: DataFrame) -> DataFrame:
    """own(g, up) -> g and the estimate of up."""
    return own.join(parents.select(F.col("g").alias("up"), F.col("mean").alias("prior_mean"), F.col("second").alias("prior_second")), "up").drop("up")


def quality(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the base counts, base_failed, distance, kept."""
    counted = appended(docs.select("doc_id", "lang", "source", "text"), ["text"], _counted, **dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"], "long")).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own, language = (F.concat(F.lit(level), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) for level, columns in (("source ", ("lang", "source")), ("language ", ("lang",))))
    counted = counted.select("*", failed.alias("base_failed"), *[c.alias(x) for c, x in zip(statistics(), STATS, strict=True)], own.alias("own"), language.alias("language"))
    counted = written(counted.drop("lang", "source"), "counted")
    sound = counted.where("not base_failed")
    every = written(estimates(sound.select(F.lit("all").alias("g"), *STATS)), "all")
    languages = written(sound.select(F.col("language").alias("g"), F.lit("all").alias("up")).distinct(), "languages")
    languages = written(estimates(sound.select(F.col("language").alias("g"), *STATS), written(_prior_of(every, languages), "priors")), "languages")
    sources = sound.select(F.col("own").alias("g"), F.col("language").alias("up")).distinct()
    models = estimates(sound.select(F.col("own").alias("g"), *STATS), written(_prior_of(languages, sources), "priors"))
    models = models.select(F.col("g").alias("own"), "mean", "inverse")
    judged = counted.join(models, "own", "left").withColumn("distance", F.round(_distance("x", "mean", "inverse"), 6))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
