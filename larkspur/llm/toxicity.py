"""Toxicity by a classifier chain.

The categories are what the labels give, predicted one after the other: 'noise' (quality label 0), then 'toxic' (toxic label 1).
Each link is a linear model that reads the text's features and the probabilities of the links before it. In training those
probabilities come out of fold, so that no link learns from predictions that an earlier link made for a row it was fitted on;
the final links are fitted on all sampled rows.

Defined results: null and empty texts have no words and are judged by the shape alone; documents without a label are judged
like others; with no labelled rows every probability is as good as nothing and no document is rejected; repeated rows count each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, everything, fresh, used
from .linear import SAMPLE, Features, Sample, logistic, sigmoid

CATEGORIES = ("noise", "toxic")
FOLDS, REJECT = 5, 0.35
#: Words count as features only if this share of the sampled texts that have them is of the category: clean words stay out.
PRECISION = 0.8


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


class Chain:
    """Fitted links: features and the weights of each link over (earlier links' logits, features)."""

    def __init__(self, features: Features, weights: list[np.ndarray]):
        self.features, self.weights = features, weights

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x = self.features.of_texts(texts)
        out = np.zeros((len(texts), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(np.concatenate((_logit(out[:, :k]), x), axis=1) @ w)
        return out


def chained(x: np.ndarray, doc_ids: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """Features of the rows, one target of 0 and 1 for each category in the chain's order -> the weights of each link."""
    fold = (doc_ids.astype(np.int64) * 2654435761 >> 7) % FOLDS
    earlier, weights = np.zeros((len(x), 0)), []
    for y in targets:
        seen = np.concatenate((_logit(earlier), x), axis=1)
        weights.append(logistic(seen, y))
        out = np.zeros(len(x))
        for k in range(FOLDS):
            held = fold == k
            if held.any():
                out[held] = sigmoid(seen[held] @ logistic(seen[~held], y[~held]))
        earlier = np.concatenate((earlier, out[:, None]), axis=1)
    return weights


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    """labels(doc_id, quality, toxic); at most size labelled documents are read."""
    s = Sample(docs, labels.where("quality is not null and toxic is not null"), ["quality", "toxic"], size)
    features = Features(s.choose([F.col("quality") == 0, F.col("toxic") == 1], precision=PRECISION))
    weights = chained(s.matrix(features), s.rows["doc_id"].to_numpy(np.int64), [(s.rows["quality"].to_numpy() == 0).astype(float), (s.rows["toxic"].to_numpy() == 1).astype(float)])
    used(s.table)
    return Chain(features, weights)


def score(docs: DataFrame, chain: Chain) -> tuple[DataFrame, list[str]]:
    """All columns of docs and a probability for each category; and the names of those columns."""
    sent = docs.sparkSession.sparkContext.broadcast((list(chain.features.at), chain.weights))
    ready: list[Chain] = []

    def run(texts: list[str | None]) -> list[list[float]]:
        if not ready:
            ready.append(Chain(Features(sent.value[0]), sent.value[1]))
        return np.round(ready[0].predict(texts), 6).T.tolist()

    names = fresh(docs, *[f"p_{c}" for c in CATEGORIES])
    return appended(docs, ["text"], run, **dict.fromkeys(names, "double")), names


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, p_noise, p_toxic, rejected (p_toxic of REJECT or more)."""
    scored, _ = score(docs.select("doc_id", "text"), fit(docs, labels, size))
    return scored.drop("text").withColumn("rejected", F.col("p_toxic") >= REJECT)


def without_toxic(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not rejected, with their columns."""
    scored, names = score(docs, fit(docs, labels, size))
    return scored.where(F.col(names[CATEGORIES.index("toxic")]) < REJECT).select(*everything(docs))
