"""Sequential learners as ordered folds: one state for each key, rows taken in order.

Rows are hash-partitioned by key and sorted by (key, order) in each partition; a step function then runs over Arrow batches with
the state carried along, so memory holds one batch and one state however long a key's sequence is. A sequence is by nature the
work of one task; the parallelism is over keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..frame import mapped


def ordered_fold(df: DataFrame, key: str, order: str, columns: Sequence[str], init: Callable[[], list], step: Callable[[list, tuple], object], schema: str, finish: Callable[[list], tuple] | None = None) -> DataFrame:
    """With finish: one row (key, *finish(state)) for each key. Without: one row (key, order, *step's tuple) for each row.

    schema names key, then the other result columns (for the row form: key, order and the step's columns).
    """
    rows = df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, o, *values in batch.itertuples(index=False, name=None):
                if state is None or k != now:
                    if finish and state is not None:
                        out.append((now, *finish(state)))
                    now, state = k, init()
                got = step(state, values)
                if not finish:
                    out.append((k, o, *got))
            if out:
                yield pd.DataFrame(out, columns=names)
        if finish and state is not None:
            yield pd.DataFrame([(now, *finish(state))], columns=names)

    return mapped(rows, run, schema)


def _loss_slope(loss: str, p: float, y: float, eps: float) -> float:
    """Derivative of a regression loss by its prediction."""
    r = p - y
    if loss == "squared_error":
        return r
    if loss == "huber":
        return r if abs(r) <= eps else math.copysign(eps, r)
    if loss == "epsilon_insensitive":
        return 0.0 if abs(r) <= eps else math.copysign(1.0, r)
    raise ValidationError("loss", "unknown", loss)


def _margin_slope(loss: str, z: float) -> float:
    """Derivative of a margin loss by the margin z = y * score."""
    if loss == "hinge":
        return -1.0 if z < 1 else 0.0
    if loss == "squared_hinge":
        return -2.0 * (1 - z) if z < 1 else 0.0
    if loss == "perceptron":
        return -1.0 if z <= 0 else 0.0
    if loss == "log_loss":
        return -1.0 / (1.0 + math.exp(min(z, 700.0)))
    if loss == "modified_huber":
        return 0.0 if z >= 1 else (-2.0 * (1 - z) if z >= -1 else -4.0)
    raise ValidationError("loss", "unknown", loss)


def rate(schedule: str, eta0: float, alpha: float, t: int, power: float = 0.25) -> float:
    if schedule == "constant":
        return eta0
    if schedule == "invscaling":
        return eta0 / (t + 1) ** power
    if schedule == "optimal":
        return 1.0 / (alpha * (t + 1))
    raise ValidationError("learning_rate", "unknown", schedule)


def _rows(values: Sequence[float], width: int) -> list[list[float]]:
    flat = [float(v) for v in values]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def _greatest(weights: Sequence[Sequence[float]], x: Sequence[float]) -> int:
    scores = [w[0] + sum(a * v for a, v in zip(w[1:], x, strict=True)) for w in weights]
    return scores.index(max(scores))


class SGDRegressor:
    """State [t, intercept, weights...]; the gradient of the weights is clipped to an L2 norm of `clip`."""

    def __init__(self, loss: str = "squared_error", penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, learning_rate: str = "invscaling", eta0: float = 0.01, epsilon: float = 0.1, clip: float = 10.0):
        _loss_slope(loss, 0.0, 0.0, epsilon)
        if penalty not in ("l1", "l2", "elasticnet", "none"):
            raise ValidationError("penalty", "unknown", penalty)
        self.loss, self.penalty, self.alpha, self.l1_ratio, self.learning_rate, self.eta0, self.epsilon, self.clip = loss, penalty, alpha, l1_ratio, learning_rate, eta0, epsilon, clip

    def init(self, width: int) -> list[float]:
        return [0, 0.0] + [0.0] * width

    def predict(self, state: list, x: Sequence[float]) -> float:
        p = state[1]
        for w, v in zip(state[2:], x, strict=True):
            p += w * v
        return p

    def pack(self, state: list) -> list[float]:
        return [float(v) for v in state]

    def unpack(self, values: Sequence[float], width: int) -> list:
        return [int(values[0]), *map(float, values[1:])]

    def error(self, state: list, x: Sequence[float], y: float) -> float:
        """Squared error of the prediction."""
        return (self.predict(state, x) - y) ** 2

    def _penalty(self, w: float) -> float:
        l1 = {"l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
        l2 = {"l2": 1.0, "elasticnet": 1 - self.l1_ratio}.get(self.penalty, 0.0)
        return self.alpha * (l1 * ((w > 0) - (w < 0)) + l2 * w)

    def learn(self, state: list, x: Sequence[float], y: float) -> None:
        slope = _loss_slope(self.loss, self.predict(state, x), y, self.epsilon)
        g = [slope * v + self._penalty(w) for v, w in zip(x, state[2:], strict=True)]
        norm = math.sqrt(sum(v * v for v in g))
        scale = self.clip / norm if norm > self.clip else 1.0
        eta = rate(self.learning_rate, self.eta0, self.alpha, state[0])
        for i, v in enumerate(g):
            state[2 + i] -= eta * scale * v
        state[1] -= eta * slope
        state[0] += 1

    def fit_keys(self, df: DataFrame, key: str, order: str, features: Sequence[str], target: str) -> DataFrame:
        """key, n, intercept, w0, w1, ..."""
        k = len(features)
        schema = f"{key} {df.schema[key].dataType.simpleString()}, n long, intercept double" + "".join(f", w{i} double" for i in range(k))
        return ordered_fold(df, key, order, [*features, target], lambda: self.init(k), lambda s, v: self.learn(s, v[:-1], v[-1]), schema, lambda s: tuple(s))

    def prequential(self, df: DataFrame, key: str, order: str, features: Sequence[str], target: str) -> DataFrame:
        """key, order, prediction (made before the row is learnt; null for a key's first row)."""
        k = len(features)

        def step(state: list, v: tuple) -> tuple:
            p = self.predict(state, v[:-1]) if state[0] else None
            self.learn(state, v[:-1], v[-1])
            return (p,)

        kind = df.schema[key].dataType.simpleString()
        return ordered_fold(df, key, order, [*features, target], lambda: self.init(k), step, f"{key} {kind}, {order} {df.schema[order].dataType.simpleString()}, prediction double")


class SGDClassifier:
    """One-vs-all: for each class a state part (intercept, weights); t advances once for each row. Unseen labels are passed over."""

    def __init__(self, classes: Sequence[int], loss: str = "hinge", alpha: float = 1e-4, learning_rate: str = "invscaling", eta0: float = 0.01):
        _margin_slope(loss, 0.0)
        self.classes, self.loss, self.alpha, self.learning_rate, self.eta0 = tuple(classes), loss, alpha, learning_rate, eta0

    def init(self, width: int) -> list:
        return [0, *[[0.0] * (width + 1) for _ in self.classes]]

    def pack(self, state: list) -> list[float]:
        return [float(state[0]), *(float(v) for w in state[1:] for v in w)]

    def unpack(self, values: Sequence[float], width: int) -> list:
        return [int(values[0]), *_rows(values[1:], width + 1)]

    def error(self, state: list, x: Sequence[float], y: float) -> float:
        """1 for a wrong class, 0 for the right one; the first class with the greatest score."""
        return float(self.classes[_greatest(state[1:], x)] != int(y))

    def learn(self, state: list, x: Sequence[float], y: float) -> None:
        if int(y) not in self.classes:
            return
        eta = rate(self.learning_rate, self.eta0, self.alpha, state[0])
        for c, w in zip(self.classes, state[1:], strict=True):
            sign = 1.0 if int(y) == c else -1.0
            z = w[0]
            for a, v in zip(w[1:], x, strict=True):
                z += a * v
            slope = _margin_slope(self.loss, sign * z) * sign
            for i, v in enumerate(x, 1):
                w[i] -= eta * (slope * v + self.alpha * w[i])
            w[0] -= eta * slope
        state[0] += 1

    def fit_keys(self, df: DataFrame, key: str, order: str, features: Sequence[str], target: str) -> DataFrame:
        """key, n, then b<c>, w<c>_<i> for each class c."""
        k = len(features)
        names = [n for c in self.classes for n in (f"b{c}", *[f"w{c}_{i}" for i in range(k)])]
        schema = f"{key} {df.schema[key].dataType.simpleString()}, n long" + "".join(f", {n} double" for n in names)
        return ordered_fold(df, key, order, [*features, target], lambda: self.init(k), lambda s, v: self.learn(s, v[:-1], v[-1]), schema, lambda s: (s[0], *[v for w in s[1:] for v in w]))


class PassiveAggressive:
    """tau = loss / (x.x + 1 / (2 C)) for every loss; zero start, so fits are deterministic. classes: None for regression."""

    def __init__(self, C: float = 1.0, epsilon: float = 0.1, classes: Sequence[int] | None = None):
        self.C, self.epsilon, self.classes = C, epsilon, tuple(classes) if classes else None

    def init(self, width: int) -> list:
        return [0.0] * (width + 1) if self.classes is None else [[0.0] * (width + 1) for _ in self.classes]

    def pack(self, state: list) -> list[float]:
        return [float(v) for v in state] if self.classes is None else [float(v) for w in state for v in w]

    def unpack(self, values: Sequence[float], width: int) -> list:
        return [float(v) for v in values] if self.classes is None else _rows(values, width + 1)

    def error(self, state: list, x: Sequence[float], y: float) -> float:
        """Squared error, or 1 for a wrong class."""
        if self.classes is None:
            return (state[0] + sum(a * v for a, v in zip(state[1:], x, strict=True)) - y) ** 2
        return float(self.classes[_greatest(state, x)] != int(y))

    def learn(self, state: list, x: Sequence[float], y: float) -> None:
        if self.classes is None:
            self._move(state, x, y)
        elif int(y) in self.classes:
            for c, w in zip(self.classes, state, strict=True):
                self._move(w, x, y, 1.0 if int(y) == c else -1.0)

    def _move(self, w: list, x: Sequence[float], y: float, sign: float | None = None) -> None:
        z, norm = w[0], 0.0
        for a, v in zip(w[1:], x, strict=True):
            z += a * v
            norm += v * v
        if sign is None:
            loss, way = max(0.0, abs(y - z) - self.epsilon), 1.0 if y >= z else -1.0
        else:
            loss, way = max(0.0, 1.0 - sign * z), sign
        if loss > 0:
            tau = way * loss / (norm + 1.0 / (2.0 * self.C))
            for i, v in enumerate(x, 1):
                w[i] += tau * v
            w[0] += tau

    def fit_keys(self, df: DataFrame, key: str, order: str, features: Sequence[str], target: str) -> DataFrame:
        k, kind = len(features), df.schema[key].dataType.simpleString()
        names = ["b", *[f"w{i}" for i in range(k)]] if self.classes is None else [n for c in self.classes for n in (f"b{c}", *[f"w{c}_{i}" for i in range(k)])]
        schema = f"{key} {kind}" + "".join(f", {n} double" for n in names)
        return ordered_fold(df, key, order, [*features, target], lambda: self.init(k), lambda s, v: self.learn(s, v[:-1], v[-1]), schema, lambda s: tuple(self.pack(s)))


class OnlineKMeans:
    """Sequential k-means: the nearest centre (the first on ties) moves to the mean of the rows it has taken.

    A centre's first row replaces it. State [counts, centres]; the target is not read.
    """

    def __init__(self, centres: Sequence[Sequence[float]]):
        self.centres = [[float(v) for v in c] for c in centres]
        if not self.centres:
            raise ValidationError("centres", "must not be empty", centres)

    def init(self, width: int) -> list:
        return [[0] * len(self.centres), [list(c) for c in self.centres]]

    def pack(self, state: list) -> list[float]:
        return [*(float(n) for n in state[0]), *(v for c in state[1] for v in c)]

    def unpack(self, values: Sequence[float], width: int) -> list:
        k = len(self.centres)
        return [[int(n) for n in values[:k]], _rows(values[k:], width)]

    @staticmethod
    def nearest(centres: Sequence[Sequence[float]], x: Sequence[float]) -> tuple[int, float]:
        gaps = [sum((a - v) ** 2 for a, v in zip(c, x, strict=True)) for c in centres]
        return gaps.index(min(gaps)), min(gaps)

    def error(self, state: list, x: Sequence[float], y: float | None = None) -> float:
        """Squared distance to the nearest centre."""
        return self.nearest(state[1], x)[1]

    def learn(self, state: list, x: Sequence[float], y: float | None = None) -> None:
        i, _ = self.nearest(state[1], x)
        state[0][i] += 1
        n = state[0][i]
        state[1][i] = [(1 - 1 / n) * c + v / n for c, v in zip(state[1][i], x, strict=True)]  # rounded as in SQL: on a lattice, distances tie to the last bit

    def fit_keys(self, df: DataFrame, key: str, order: str, features: Sequence[str]) -> DataFrame:
        """key, then n<c>, c<c>_<i> for each centre c."""
        k, width = len(self.centres), len(features)
        schema = f"{key} {df.schema[key].dataType.simpleString()}" + "".join(f", n{c} double" for c in range(k)) + "".join(f", c{c}_{i} double" for c in range(k) for i in range(width))
        return ordered_fold(df, key, order, list(features), lambda: self.init(width), lambda s, v: self.learn(s, v), schema, lambda s: tuple(self.pack(s)))


class DDM:
    """Drift detection: after `least` rows, p = error share and s = sqrt(p (1 - p) / n); against the smallest p + s so far."""

    def __init__(self, least: int = 30, warn: float = 2.0, drift: float = 3.0):
        self.least, self.warn, self.drift = least, warn, drift

    def init(self) -> list:
        return [0, 0, math.inf, math.inf, 0, 0]  # n, errors, p_min, s_min, warnings, drifts

    def update(self, s: list, correct: bool) -> str:
        s[0] += 1
        s[1] += 0 if correct else 1
        if s[0] < self.least:
            return "stable"
        p = s[1] / s[0]
        d = math.sqrt(p * (1 - p) / s[0])
        if p + d < s[2] + s[3]:
            s[2], s[3] = p, d
        if p + d > s[2] + self.drift * s[3]:
            s[:4] = [0, 0, math.inf, math.inf]
            s[5] += 1
            return "drift"
        if p + d > s[2] + self.warn * s[3]:
            s[4] += 1
            return "warning"
        return "stable"

    def fold_keys(self, df: DataFrame, key: str, order: str, correct: str) -> DataFrame:
        """key, n (since the last drift), warnings, drifts."""
        kind = df.schema[key].dataType.simpleString()
        return ordered_fold(df, key, order, [correct], self.init, lambda s, v: self.update(s, bool(v[0])), f"{key} {kind}, n long, warnings long, drifts long", lambda s: (s[0], s[4], s[5]))


class ADWIN:
    """Simplified adaptive window: buckets of at most two rows; cut at the first split whose means differ too much, from LEAST rows on."""

    LEAST = 5  # fixed value

    def __init__(self, delta: float = 0.002, most: int = 200):
        self.delta, self.most = delta, most

    def update(self, s: list, value: float) -> bool:
        """s: [buckets of (n, sum), drifts]."""
        buckets = s[0]
        if buckets and buckets[-1][0] == 1:
            buckets[-1] = (2, buckets[-1][1] + value)
        else:
            buckets.append((1, value))
        if len(buckets) > self.most:
            buckets.pop(0)
        n, total = sum(b[0] for b in buckets), sum(b[1] for b in buckets)
        if n < self.LEAST:
            return False
        n0 = t0 = 0
        for i, (c, v) in enumerate(buckets[:-1]):
            n0, t0 = n0 + c, t0 + v
            n1 = n - n0
            if abs(t0 / n0 - (total - t0) / n1) > math.sqrt(0.5 * (1 / n0 + 1 / n1) * math.log(2 / self.delta)):
                s[0] = buckets[i + 1 :]
                s[1] += 1
                return True
        return False

    def fold_keys(self, df: DataFrame, key: str, order: str, value: str) -> DataFrame:
        """key, drifts, width (rows in the last window), mean."""
        kind = df.schema[key].dataType.simpleString()
        finish = lambda s: (s[1], sum(b[0] for b in s[0]), sum(b[1] for b in s[0]) / max(1, sum(b[0] for b in s[0])))
        return ordered_fold(df, key, order, [value], lambda: [[], 0], lambda s, v: self.update(s, float(v[0])), f"{key} {kind}, drifts long, width long, mean double", finish)


def correct(df: DataFrame, y: str, p: str, to: str = "correct") -> DataFrame:
    return df.withColumn(to, F.abs(F.col(y) - F.col(p)) < 1e-10)
