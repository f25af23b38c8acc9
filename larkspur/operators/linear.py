"""Least squares from one aggregate of moments, logistic regression by distributed gradients, and linear prediction."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyDataError, ModelError, SingularMatrixError, ValidationError
from ..frame import check_columns, num
from ..functions.numeric import linear, sigmoid, softmax
from . import metrics


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float = 0.0
    model_type: str = "LinearRegression"
    params: dict = field(default_factory=dict)

    def expression(self) -> Column:
        return linear(self.features, self.coefficients, self.intercept)

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        check_columns("predict", df, self.features)
        return df.withColumn(to, self.expression())

    def score(self, df: DataFrame, target: str) -> float:
        return metrics.score(self.predict(df, "__p"), "r2", target, "__p")

    def weight_hash(self) -> str:
        """SHA-256 of the coefficients and intercept as JSON with 17 significant digits."""
        return hashlib.sha256(json.dumps([float(f"{v:.17g}") for v in (*self.coefficients, self.intercept)]).encode()).hexdigest()

    def to_json(self) -> str:
        spec = {"name": self.model_type, "format_version": "1.0"}
        params = {"coefficients": list(self.coefficients), "intercept": self.intercept, "n_features": len(self.coefficients), "features": list(self.features)}
        return json.dumps({"model_spec": spec, "params": params, "checksum": self.weight_hash()})

    @classmethod
    def from_json(cls, text: str, features: Sequence[str] | None = None) -> LinearModel:
        try:
            j = json.loads(text)
            spec, params = j["model_spec"], j["params"]
            weights = tuple(map(float, params["coefficients"]))
        except (ValueError, KeyError, TypeError) as e:
            raise ModelError("from_json", "malformed model", e) from e
        if spec.get("format_version") != "1.0":
            raise ValidationError("format_version", "must be 1.0", spec.get("format_version"))
        if not spec.get("name"):
            raise ValidationError("name", "must not be empty", spec.get("name"))
        if params.get("n_features") != len(weights):
            raise ValidationError("n_features", f"must be {len(weights)}", params.get("n_features"))
        out = cls(tuple(features or params.get("features") or [f"x{i}" for i in range(len(weights))]), weights, float(params["intercept"]), spec["name"])
        if "checksum" in j and j["checksum"] != out.weight_hash():
            raise ValidationError("checksum", "does not match the weights", j["checksum"])
        return out


def moments(features: Sequence[str], target: str, weight: str | None = None) -> list[Column]:
    """Sums of all products of (1, features, target): one aggregate, combined before the shuffle."""
    cols = [F.lit(1.0), *[num(f) for f in features], num(target)]
    w = num(weight) if weight else F.lit(1.0)
    return [F.sum(w * cols[i] * cols[j]).alias(f"m_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def normal_matrix(row: dict, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = float(row[f"m_{i}_{j}"] or 0.0)
    return m


class LinearRegression:
    """Ordinary least squares. positive: negative coefficients become 0 after the fit. alpha: an L2 penalty on them."""

    def __init__(self, fit_intercept: bool = True, positive: bool = False, alpha: float = 0.0):
        self.fit_intercept, self.positive, self.alpha = fit_intercept, positive, alpha

    def solve(self, m: np.ndarray, features: Sequence[str]) -> LinearModel:
        k = len(features)
        if m[0, 0] <= 0:
            raise EmptyDataError("LinearRegression: no rows")
        xx, xy = m[1 : k + 1, 1 : k + 1], m[1 : k + 1, k + 1]
        mean, y_mean = (m[0, 1 : k + 1] / m[0, 0], m[0, k + 1] / m[0, 0]) if self.fit_intercept else (np.zeros(k), 0.0)
        if self.fit_intercept:  # centred, for a better condition
            xx, xy = xx - m[0, 0] * np.outer(mean, mean), xy - m[0, 0] * mean * y_mean
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        a = xx / np.outer(scale, scale) + self.alpha * np.diag(1 / scale**2)
        if k and (np.diag(xx) <= 1e-12 * max(1.0, m[0, 0])).any() or k and np.linalg.cond(a) > 1e13:
            raise SingularMatrixError("LinearRegression: features are constant or depend on each other")
        w = np.linalg.solve(a, xy / scale) / scale if k else np.zeros(0)
        if self.positive:
            w = np.maximum(w, 0.0)
        return LinearModel(tuple(features), tuple(map(float, w)), float(y_mean - mean @ w) if self.fit_intercept else 0.0)

    def fit(self, df: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> LinearModel:
        check_columns("LinearRegression", df, [*features, target])
        row = df.agg(*moments(features, target, weight)).first().asDict()
        return self.solve(normal_matrix(row, len(features) + 2), features)

    def fit_grouped(self, df: DataFrame, key: str, features: Sequence[str], target: str) -> dict[object, np.ndarray]:
        """The normal matrix of each value of key (few values, such as folds), from one aggregate."""
        rows = df.groupBy(key).agg(*moments(features, target)).collect()
        return {r[key]: normal_matrix(r.asDict(), len(features) + 2) for r in rows}


@dataclass(frozen=True)
class ClassifierModel:
    """One linear score for each class (one score in all for two classes with link 'binary')."""

    features: tuple[str, ...]
    classes: tuple[int, ...]
    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    link: str = "softmax"

    def scores(self) -> list[Column]:
        return [linear(self.features, w, b) for w, b in zip(self.coefficients, self.intercepts, strict=True)]

    def probabilities(self) -> list[Column]:
        if len(self.coefficients) == 1:
            p = sigmoid(self.scores()[0])
            return [1 - p, p]
        return softmax(self.scores())

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        check_columns("predict", df, self.features)
        s = self.scores()
        if len(s) == 1:
            at = s[0] >= 0
            return df.withColumn(to, F.when(at, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        out, best = F.lit(self.classes[0]), s[0]
        for c, x in zip(self.classes[1:], s[1:], strict=True):
            out, best = F.when(x > best, F.lit(c)).otherwise(out), F.greatest(best, x)
        return df.withColumn(to, out)

    def predict_proba(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        check_columns("predict_proba", df, self.features)
        return df.withColumns({f"{prefix}{c}": p for c, p in zip(self.classes, self.probabilities(), strict=True)})


class LogisticRegression:
    """Mean logistic loss + w.w / (2 C); the intercept is free. One-vs-rest beyond two classes.

    solver 'gd': fixed or shrinking steps, each one aggregate of f + 1 sums; 'newton': each step one aggregate of the gradient and
    the Hessian's (f + 1)(f + 2) / 2 sums, quadratic convergence. Weights start at zero. Other penalties than L2 are refused.
    """

    def __init__(self, C: float = 1.0, solver: str = "newton", max_iter: int = 50, tol: float = 1e-8, step: float = 1.0, decay: float = 0.1, penalty: str = "l2"):
        if penalty != "l2":
            raise ValidationError("penalty", "only l2 is supported", penalty)
        if solver not in ("gd", "newton"):
            raise ValidationError("solver", "gd or newton", solver)
        self.C, self.solver, self.max_iter, self.tol, self.step, self.decay = C, solver, max_iter, tol, step, decay

    def classes(self, df: DataFrame, target: str) -> list[int]:
        return sorted(int(r[0]) for r in df.select(F.col(target).cast("int")).distinct().limit(1001).collect())

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> ClassifierModel:
        check_columns("LogisticRegression", df, [*features, target])
        classes = self.classes(df, target)
        if len(classes) < 2:
            raise ValidationError(target, "needs two classes", classes)
        wanted = classes[1:] if len(classes) == 2 else classes
        fits = [self._binary(df, features, F.when(F.col(target).cast("int") == c, 1.0).otherwise(0.0)) for c in wanted]
        return ClassifierModel(tuple(features), tuple(classes), tuple(tuple(w[1:]) for w in fits), tuple(w[0] for w in fits))

    def _binary(self, df: DataFrame, features: Sequence[str], y: Column) -> list[float]:
        k = len(features) + 1
        x = [F.lit(1.0), *[num(f) for f in features]]
        w, pen = np.zeros(k), np.r_[0.0, np.full(k - 1, 1.0 / self.C)]
        for it in range(self.max_iter):
            p = sigmoid(linear(features, w[1:], w[0]))
            sums = [F.avg((p - y) * c) for c in x]
            if self.solver == "newton":
                sums += [F.avg(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
            row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
            g = np.array(row[:k], float) + pen * w
            if np.abs(g).max() < self.tol:
                break
            if self.solver == "gd":
                w = w - self.step / (1 + self.decay * it) * g
            else:
                h = np.zeros((k, k))
                h[np.triu_indices(k)] = row[k:]
                h = h + np.triu(h, 1).T + np.diag(pen) + 1e-12 * np.eye(k)
                w = w - np.linalg.solve(h, g)
        return [float(v) for v in w]


def rounded(model: LinearModel, digits: int) -> LinearModel:
    return replace(model, coefficients=tuple(round(v, digits) for v in model.coefficients), intercept=round(model.intercept, digits))
