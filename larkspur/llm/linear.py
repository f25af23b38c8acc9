"""Linear text classifiers over word presence and shape, fitted on a bounded sample of labelled rows.

A text becomes the set of its hashed words and beginnings of words (SLOTS slots) and a few shape values. Fitting reads at most
`sample` labelled documents (those with the smallest hash of their doc_id); documents that share their three smallest slot hashes
count once, so that copies do not make their words look meaningful. The slots with the highest chi-square for a label are its
features; they are counted by Spark, and only the chosen features of the sampled texts reach the driver, whatever the texts'
length. Newton steps fit an L2-penalised logistic model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, used, written

SLOTS = 1 << 22
SAMPLE = 6000
_WORD = re.compile(r"[^\W\d_]+")
SHAPE = 7


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def slots_of(word: str) -> list[int]:
    """The slots of a word and of its beginnings, so that forms of a stem share features."""
    names = [word] + [f"^{word[:n]}" for n in (4, 5, 7) if len(word) >= n]
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS for w in names]


def slots(text: str | None) -> list[int]:
    return sorted({s for w in words(text) for s in slots_of(w)})


def shape(text: str | None) -> list[float]:
    """Shares of symbols, bars, exclamation marks, digits and upper case; repetition; log length. Each about 0 to 3."""
    t = text or ""
    n = max(len(t), 1)
    split = t.split()
    symbols = sum(map(t.count, "#*$%&"))
    upper = sum(map(t.count, "AEIOUNRST"))
    digits = sum(map(t.count, "0123456789"))
    return [min(3.0, 20 * symbols / n), min(3.0, 20 * t.count("|") / n), min(3.0, 20 * t.count("!") / n), min(3.0, 20 * digits / n), min(3.0, 10 * upper / n), 1 - len(set(split)) / max(len(split), 1), np.log1p(len(split)) / 5]


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [np.array(slots(t), np.int32) for t in batch["text"]]
        sketch = [np.sort(s.astype(np.uint32) * np.uint32(2654435761))[:3].tobytes() or f"{i}".encode() for s, i in zip(found, batch["doc_id"], strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "slots": found, "shape": [shape(t) for t in batch["text"]], "sketch": sketch})


class Sample:
    """At most size labelled documents: a written table (doc_id, slots, shape, label columns), and all but the slots on the driver."""

    def __init__(self, docs: DataFrame, labels: DataFrame, columns: list[str], size: int = SAMPLE):
        labels = labels.select("doc_id", *columns).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("x")).select("doc_id", "x.*")
        chosen = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = written(chosen, "chosen")
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # size rows at most
        found = mapped(texts, _described, "doc_id long, slots array<int>, shape array<double>, sketch binary")
        once = found.groupBy("sketch").agg(F.min(F.struct("doc_id", "shape", "slots")).alias("x")).select("x.*")
        once = once.groupBy("doc_id").agg(F.min(F.struct("shape", "slots")).alias("x")).select("doc_id", "x.*")
        self.table = written(once.join(F.broadcast(chosen), "doc_id"), "sample")
        self.rows = self.table.drop("slots").toPandas().sort_values("doc_id").reset_index(drop=True)
        used(chosen)

    def choose(self, targets: list[Column], each: int = 200, least: int = 6, precision: float = 0.0) -> list[int]:
        """The slots of highest chi-square for each target, among those in `least` rows whose share of positives is `precision`."""
        names = [f"t{i}" for i in range(len(targets))]
        marks = self.table.select(F.explode("slots").alias("slot"), *[F.coalesce(t, F.lit(False)).cast("int").alias(n) for t, n in zip(targets, names, strict=True)])
        counts = written(marks.groupBy("slot").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in names]).where(F.col("n") >= least), "slots")
        size = len(self.rows)
        shares = self.table.agg(*[F.avg(F.coalesce(t, F.lit(False)).cast("double")) for t in targets]).first() if targets else []
        chosen: dict[int, None] = {}
        for name, share in zip(names, shares, strict=True):
            if not size or not 0 < share < 1:
                continue
            expected = F.col("n") * float(share)
            chi = (F.col(name) - expected) * (F.col(name) - expected) / F.greatest(expected * (1 - float(share)), F.lit(1e-9))
            best = counts.select("slot", name, "n", chi.alias("chi")).where((F.col("chi") > 15) & (F.col(name) >= precision * F.col("n"))).orderBy(F.col("chi").desc(), "slot").limit(each)
            chosen |= dict.fromkeys(r["slot"] for r in best.collect())
        used(counts)
        return list(chosen)

    def matrix(self, features: Features) -> np.ndarray:
        """A row for each of `rows`."""
        known = features.at

        def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "at": [[known[s] for s in x if s in known] for x in b["slots"]]})

        have = mapped(self.table.select("doc_id", "slots"), kept, "doc_id long, at array<int>").toPandas().sort_values("doc_id")
        x = np.zeros((len(have), features.width))
        for k, (at, values) in enumerate(zip(have["at"], self.rows["shape"], strict=True)):
            x[k, list(at)] = 1
            x[k, -SHAPE - 1 : -1] = values
        x[:, -1] = 1
        return x


class Features:
    """The chosen slots, and rows of presence and shape values for texts."""

    def __init__(self, chosen: list[int]):
        self.at = {s: i for i, s in enumerate(chosen)}
        self.width = len(chosen) + SHAPE + 1
        self._known: dict[str, tuple[int, ...]] = {}

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), self.width))
        known = self._known
        for k, t in enumerate(texts):
            for piece in set((t or "").split()):
                found = known.get(piece)
                if found is None:
                    found = tuple(self.at[s] for w in words(piece) for s in slots_of(w) if s in self.at)  # most are empty, and all those are one object
                    if len(known) < 300_000:
                        known[piece] = found
                for i in found:
                    x[k, i] = 1
            x[k, -SHAPE - 1 : -1] = shape(t)
        x[:, -1] = 1
        return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * z) + 1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.2, steps: int = 25) -> np.ndarray:
    """Weights of an L2-penalised logistic model (the last column, a constant, is not penalised); Newton steps, halved as needed."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    if not len(y) or y.min() == y.max():
        w[-1] = 8.0 if len(y) and y[0] else -8.0
        return w

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (v * v))

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(ridge)
        move, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-4 and loss(w - scale * move) > now:
            scale /= 2
        w = w - scale * move
        last, now = now, loss(w)
        if last - now < 1e-6:
            break
    return w
