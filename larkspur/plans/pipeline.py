"""Pipelines of estimators. Each transformer turns into projections; only its statistics cost a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import NotFittedError, ValidationError


class Pipeline:
    """steps: (name, estimator); all but the last transform. fit(df, features, target)."""

    def __init__(self, steps: Sequence[tuple[str, object]]):
        names = [n for n, _ in steps]
        if not steps or len(set(names)) != len(names):
            raise ValidationError("steps", "needs steps with distinct names", names)
        self.steps, self.models, self.features, self.target = list(steps), None, (), None

    @classmethod
    def make(cls, *estimators: object) -> Pipeline:
        return cls([(f"step{i}", e) for i, e in enumerate(estimators, 1)])

    def get_params(self) -> dict:
        return {f"{n}__{k}": v for n, e in self.steps for k, v in vars(e).items() if not k.startswith("_")}

    def fit(self, df: DataFrame, features: Sequence[str], target: str | None = None) -> Pipeline:
        models, now = [], df
        for i, (_, e) in enumerate(self.steps):
            last = i == len(self.steps) - 1
            if last and hasattr(e, "fit") and target is not None and not hasattr(e, "fit_transform"):
                models.append(e.fit(now, features, target))
            else:
                m = e.fit(now, features)
                models.append(m)
                now = m.transform(now)
        self.models, self.features, self.target = models, tuple(features), target
        return self

    def _fitted(self, method: str) -> list:
        if self.models is None:
            raise NotFittedError("Pipeline", method)
        return self.models

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self._fitted("transform"):
            if hasattr(m, "transform"):
                df = m.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for m in reversed(self._fitted("inverse_transform")):
            if hasattr(m, "inverse_transform"):
                df = m.inverse_transform(df)
        return df

    def fit_transform(self, df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
        return self.fit(df, features, target).transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self._fitted("predict")[-1].predict(self.transform(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._fitted("predict_proba")[-1].predict_proba(self.transform(df))

    def score(self, df: DataFrame) -> float:
        return self._fitted("score")[-1].score(self.transform(df), self.target)
