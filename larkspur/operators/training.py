"""Boosting as a user meets it: regressor and classifier, train and cv, trials over a grid, callbacks.

All of these are driver loops around GradientBoosting; every fit, prediction and score is a Spark job.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotFittedError, ValidationError
from ..frame import num
from . import metrics
from .boosting import GradientBoosting, Round, response
from .nodes import Ensemble
from .selection import cross_validate_with

Callback = Callable[[Round], "bool | None"]


# Callbacks.


def record(into: dict[str, list[float]]) -> Callback:
    """Losses of each round by name."""

    def after(r: Round) -> None:
        for name, value in r.losses.items():
            into.setdefault(name, []).append(value)

    return after


def printed(every: int = 1, out: Callable[[str], object] = print) -> Callback:
    def after(r: Round) -> None:
        if every > 0 and (r.number + 1) % every == 0:
            out(f"[{r.number + 1}] " + " ".join(f"{k}: {v:.6g}" for k, v in r.losses.items()))

    return after


def time_limit(seconds: float) -> Callback:
    """Stop after the round in which the time is up."""
    return lambda r: time.monotonic() - r.began >= seconds


def reset_parameter(**changes: Sequence | Callable[[int], object]) -> Callback:
    """Values of parameters for the rounds after the first, as a list by round or a function of it."""

    def after(r: Round) -> None:
        for name, values in changes.items():
            if name not in GradientBoosting.DEFAULTS:
                raise ValidationError(name, "unknown parameter")
            if callable(values):
                r.params[name] = values(r.number + 1)
            elif r.number + 1 < len(values):
                r.params[name] = values[r.number + 1]

    return after


def learning_rates(schedule: Sequence[float] | Callable[[int], float]) -> Callback:
    return reset_parameter(learning_rate=schedule)


def checkpoint(save: Callable[[Ensemble, int], object], period: int = 1, if_improved: bool = False, loss: str = "valid") -> Callback:
    """save(model, round) every `period` rounds; with if_improved, only when the loss is the best so far."""
    best = math.inf

    def after(r: Round) -> None:
        nonlocal best
        if (r.number + 1) % max(1, period):
            return
        value = r.losses.get(loss, math.inf)
        if not if_improved or value < best:
            best = min(best, value)
            save(r.model, r.number)

    return after


def plateau(losses: Sequence[float], tol: float, last: int = 5) -> bool:
    """The range of the last losses is below tol."""
    seen = list(losses)[-last:]
    return len(seen) == last and max(seen) - min(seen) < tol


def rising(losses: Sequence[float], last: int = 5) -> bool:
    """Each of the last losses is above the one before it."""
    seen = list(losses)[-last:]
    return len(seen) == last and all(a < b for a, b in zip(seen, seen[1:], strict=False))


# Regressor and classifier.


class BoostedRegressor:
    """fit(df, features, target, key), predict, score (r2)."""

    def __init__(self, **params):
        self.booster, self.model = GradientBoosting(**params), None
        if self.booster.p["objective"] in ("binary", "multiclass"):
            raise ValidationError("objective", "must be one for numbers", self.booster.p["objective"])

    def fit(self, df: DataFrame, features: Sequence[str], target: str, key: str, **more) -> BoostedRegressor:
        """more: weight, init, valid, callbacks (see GradientBoosting.fit)."""
        self.model = self.booster.fit(df, features, target, key, **more)
        return self

    def _fitted(self, method: str) -> Ensemble:
        if self.model is None:
            raise NotFittedError(type(self).__name__, method)
        return self.model

    def predict(self, df: DataFrame, to: str = "prediction", best: int | None = None) -> DataFrame:
        m = self._fitted("predict")
        if best is not None:
            m = Ensemble(m.features, m.trees[: best * m.classes], m.init, m.objective, m.params)
        scored = m.score(df, "__raw")
        return scored.withColumn(to, response(m.objective, [F.col("__raw0")])[0]).drop("__raw0")

    def score(self, df: DataFrame, target: str) -> float:
        return metrics.score(self.predict(df, "__p"), "r2", target, "__p")


class BoostedClassifier:
    """Labels of any type; two of them give a binary model, more a multiclass one. Ties go to the first label in order."""

    def __init__(self, **params):
        self.params, self.model, self.labels = params, None, []
        GradientBoosting(**{k: v for k, v in params.items() if k != "objective"})  # refuses unknown parameters now

    def fit(self, df: DataFrame, features: Sequence[str], target: str, key: str, valid: DataFrame | None = None, **more) -> BoostedClassifier:
        self.labels = sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().collect())  # a row for each class
        if len(self.labels) < 2:
            raise ValidationError(target, "needs two classes at least", self.labels)
        objective = {"objective": "binary"} if len(self.labels) == 2 else {"objective": "multiclass", "num_class": len(self.labels)}
        self.booster = GradientBoosting(**({k: v for k, v in self.params.items() if k not in ("objective", "num_class")} | objective))
        coded = lambda d: d if d is None else d.where(F.col(target).isNotNull()).withColumn(target, self.code(F.col(target)))
        self.model = self.booster.fit(coded(df), features, target, key, valid=coded(valid), **more)
        return self

    def code(self, label: Column) -> Column:
        out = F.lit(None).cast("double")
        for i, c in enumerate(self.labels):
            out = F.when(label == F.lit(c), float(i)).otherwise(out)
        return out

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        """p0, p1, ... in the order of labels."""
        if self.model is None:
            raise NotFittedError("BoostedClassifier", "predict_proba")
        k = self.model.classes
        scored = self.model.score(df, "__raw")
        out = response(self.model.objective, [F.col(f"__raw{i}") for i in range(k)])
        out = [1 - out[0], out[0]] if k == 1 else out
        return scored.withColumns({f"{prefix}{i}": c for i, c in enumerate(out)}).drop(*[f"__raw{i}" for i in range(k)])

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        n = len(self.labels)
        scored = self.predict_proba(df, "__p")
        top = F.greatest(*[F.col(f"__p{i}") for i in range(n)])
        said = F.lit(self.labels[-1])
        for i in range(n - 2, -1, -1):
            said = F.when(F.col(f"__p{i}") == top, F.lit(self.labels[i])).otherwise(said)
        return scored.withColumn(to, said).drop(*[f"__p{i}" for i in range(n)])

    def score(self, df: DataFrame, target: str) -> float:
        """Accuracy."""
        return float(self.predict(df, "__said").agg(F.avg((F.col("__said") == F.col(target)).cast("double"))).first()[0])


# Training functions.


def train(params: dict, df: DataFrame, features: Sequence[str], target: str, key: str, num_boost_round: int | None = None, valid: DataFrame | None = None, callbacks: Sequence[Callback] = ()) -> Ensemble:
    """A model by parameters under any of their names."""
    given = dict(params) | ({"rounds": num_boost_round} if num_boost_round is not None else {})
    return GradientBoosting(**given).fit(df, features, target, key, valid=valid, callbacks=callbacks)


def cv(params: dict, df: DataFrame, features: Sequence[str], target: str, key: str, k: int = 5, seed: int | None = None, stratified: bool = False) -> dict[str, float | list[float]]:
    """The loss of each held-out fold, their mean and sample deviation."""
    booster = GradientBoosting(**params)
    rows = cross_validate_with(df, key, k, lambda d: booster.fit(d, features, target, key), lambda m, d: {"loss": booster.loss(d, m, target)}, seed, target if stratified else None)
    losses = [r["loss"] for r in rows]
    mean = sum(losses) / len(losses)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in losses) / (len(losses) - 1)) if len(losses) > 1 else 0.0
    return {"losses": losses, "mean": mean, "std": deviation}


# Leaves, learning rate and rounds of the trials.
GRID = ({"num_leaves": 31, "learning_rate": 0.1, "rounds": 100}, {"num_leaves": 15, "learning_rate": 0.05, "rounds": 200}, {"num_leaves": 63, "learning_rate": 0.1, "rounds": 50}, {"num_leaves": 31, "learning_rate": 0.05, "rounds": 150})


def quick(df: DataFrame, features: Sequence[str], target: str, key: str, grid: Sequence[dict] = GRID, folds: int = 3, **params) -> tuple[dict, Ensemble]:
    """The parameters of the grid with the least loss over folds, and a model of all rows with them. The task follows from the target."""
    from .preprocessing import task_type

    if "objective" not in params:
        kind = task_type(df, target)
        n = df.select(target).distinct().count() if kind == "classification" else 0
        params |= {"objective": "l2"} if not n else {"objective": "binary"} if n == 2 else {"objective": "multiclass", "num_class": n}
    tried = [(cv(params | g, df, features, target, key, folds)["mean"], i) for i, g in enumerate(grid)]
    best = params | grid[min(tried)[1]]
    return best, GradientBoosting(**best).fit(df, features, target, key)


def residuals(df: DataFrame, target: str, prediction: str = "prediction", to: str = "residual") -> DataFrame:
    return df.withColumn(to, num(target) - num(prediction))
