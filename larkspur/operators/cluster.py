"""k-means over an array<double> column: assignment, distances, inertia, Lloyd steps and mini-batch folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyDataError, NotFittedError, ValidationError
from ..functions.numeric import squared_distance
from .folds import OnlineKMeans
from .selection import mini_batch


def centre_columns(centres: Sequence[Sequence[float]]) -> list[Column]:
    return [F.array(*[F.lit(float(v)) for v in c]) for c in centres]


def nearest(vector: Column, centres: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """(index of the nearest centre, the first on ties; squared distance). k is small: an expression, no join."""
    best = F.array_min(F.array(*[F.struct(squared_distance(vector, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centre_columns(centres))]))
    return best["i"], best["d"]


def assign(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """df with cluster and distance (squared)."""
    best = F.array_min(F.array(*[F.struct(squared_distance(F.col(vector), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centre_columns(centres))]))
    return df.withColumn("__b", best).select(*df.columns, F.col("__b.i").alias("cluster"), F.col("__b.d").alias("distance"))


def distances(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """df with d0, d1, ...: Euclidean distances."""
    return df.withColumns({f"d{i}": F.sqrt(squared_distance(F.col(vector), c)) for i, c in enumerate(centre_columns(centres))})


def inertia(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    return assign(df, vector, centres).agg(F.sum("distance").alias("inertia"), F.count("*").alias("n"))


def lloyd_sums(df: DataFrame, vector: str, centres: Sequence[Sequence[float]], width: int) -> DataFrame:
    """cluster, n, c (mean vector). One pass, combined before the shuffle."""
    a = assign(df, vector, centres)
    g = a.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.get(vector, F.lit(j))).alias(f"c{j}") for j in range(width)])
    return g.select("cluster", "n", F.array(*[f"c{j}" for j in range(width)]).alias("c"))


class KMeans:
    """Lloyd's algorithm from given or k-means++ centres; the start comes from a bounded sample of `sample` rows by hash of the key."""

    def __init__(self, k: int, max_iter: int = 20, tol: float = 1e-6, sample: int = 10_000, seed: int = 1):
        self.k, self.max_iter, self.tol, self.sample, self.seed = k, max_iter, tol, sample, seed

    def start(self, df: DataFrame, vector: str, key: str) -> np.ndarray:
        rows = df.orderBy(F.xxhash64(key, F.lit(self.seed))).limit(self.sample).select(vector).collect()
        x = np.array([r[0] for r in rows], float)
        r = np.random.Generator(np.random.PCG64(self.seed))
        centres = [x[r.integers(len(x))]]
        while len(centres) < min(self.k, len(x)):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            if d.sum() <= 0:
                break
            centres.append(x[r.choice(len(x), p=d / d.sum())])
        return np.array(centres)

    def fit(self, df: DataFrame, vector: str, key: str, centres: np.ndarray | None = None) -> np.ndarray:
        c = self.start(df, vector, key) if centres is None else np.array(centres, float)
        for _ in range(self.max_iter):
            new = c.copy()
            for r in lloyd_sums(df, vector, c.tolist(), c.shape[1]).collect():  # k rows
                new[r["cluster"]] = r["c"]
            moved = float(np.abs(new - c).max())
            c = new
            if moved < self.tol:
                break
        return c


class MiniBatchKMeans:
    """Mini-batches of `batch_size` rows (a bounded number, in seeded hash order), folded row by row on the driver (see OnlineKMeans).

    After each batch the inertia of all rows is one aggregate; `patience` batches that do not lower it by tol end a run. The best
    of n_init runs stays. partial_fit takes all rows given to it, as two sums for each centre: rows go to the centre that is
    nearest before the call. Streams: streaming.StreamingFold with OnlineKMeans.
    """

    def __init__(self, k: int, batch_size: int = 100, max_iter: int = 100, n_init: int = 3, tol: float = 1e-4, patience: int = 10, init: str = "k-means++", sample: int = 10_000, seed: int = 1):
        if init not in ("k-means++", "random"):
            raise ValidationError("init", "k-means++ or random", init)
        self.k, self.batch_size, self.max_iter, self.n_init, self.tol, self.patience, self.init, self.sample, self.seed = k, batch_size, max_iter, n_init, tol, patience, init, sample, seed
        self.centres: np.ndarray | None = None
        self.counts: np.ndarray | None = None
        self.inertia, self.steps = np.inf, 0

    def _start(self, df: DataFrame, vector: str, key: str, run: int) -> np.ndarray:
        if self.init == "random":
            rows = mini_batch(df, key, self.k, self.seed + 7919 * (run + 1)).select(vector).collect()  # k rows
            return np.array([r[0] for r in rows], float)
        return KMeans(self.k, sample=self.sample, seed=self.seed + run).start(df, vector, key)

    def fit(self, df: DataFrame, vector: str, key: str) -> MiniBatchKMeans:
        self.inertia = np.inf
        for run in range(self.n_init):
            centres = self._start(df, vector, key, run)
            if not len(centres):
                raise EmptyDataError("MiniBatchKMeans: no rows")
            learner, width = OnlineKMeans(centres.tolist()), centres.shape[1]
            state, last, idle, step = learner.init(width), np.inf, 0, 0
            for step in range(1, self.max_iter + 1):
                for r in mini_batch(df, key, self.batch_size, self.seed + 104_729 * run + step).orderBy(key).select(vector).collect():  # batch_size rows
                    learner.learn(state, list(r[0]))
                now = float(inertia(df, vector, state[1]).first()["inertia"])
                idle = 0 if last - now >= self.tol else idle + 1
                last = now
                if idle >= self.patience:
                    break
            if last < self.inertia:
                self.centres, self.counts, self.inertia, self.steps = np.array(state[1]), np.array(state[0]), last, step
        return self

    def partial_fit(self, df: DataFrame, vector: str, key: str) -> MiniBatchKMeans:
        if self.centres is None:
            self.centres = self._start(df, vector, key, 0)
            self.counts = np.zeros(len(self.centres), int)
        for r in lloyd_sums(df, vector, self.centres.tolist(), self.centres.shape[1]).collect():  # k rows
            i, n = r["cluster"], r["n"]
            whole = self.counts[i] + n
            self.centres[i] = (self.counts[i] * self.centres[i] + n * np.array(r["c"])) / whole
            self.counts[i] = whole
        return self

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        return assign(df, vector, self._fitted("predict"))

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        return distances(df, vector, self._fitted("transform"))

    def _fitted(self, method: str) -> list[list[float]]:
        if self.centres is None:
            raise NotFittedError("MiniBatchKMeans", method)
        return self.centres.tolist()
