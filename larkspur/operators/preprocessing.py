"""Scalers and the one-hot encoder. Fitting is one aggregate; transforming is one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyDataError, ValidationError
from ..frame import check_columns, num

TINY = 1e-8


@dataclass(frozen=True)
class ScalerModel:
    """x -> (x - shift) / scale * gain + base, column by column, and back."""

    features: tuple[str, ...]
    shift: tuple[float, ...]
    scale: tuple[float, ...]
    gain: float = 1.0
    base: float = 0.0

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        check_columns("transform", df, self.features)
        return df.withColumns({f"{c}{suffix}": (num(c) - F.lit(m)) / F.lit(s) * F.lit(self.gain) + F.lit(self.base) for c, m, s in zip(self.features, self.shift, self.scale, strict=True)})

    def inverse_transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        check_columns("inverse_transform", df, self.features)
        return df.withColumns({f"{c}{suffix}": (num(c) - F.lit(self.base)) / F.lit(self.gain) * F.lit(s) + F.lit(m) for c, m, s in zip(self.features, self.shift, self.scale, strict=True)})


class StandardScaler:
    """Population deviation about the mean (about zero without with_mean); a deviation under 1e-8 counts as 1."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std = with_mean, with_std

    def statistics(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        check_columns("StandardScaler", df, features)
        parts = []
        for c in features:
            spread = F.stddev_pop(num(c)) if self.with_mean else F.sqrt(F.avg(num(c) * num(c)))
            parts += [(F.avg(num(c)) if self.with_mean else F.lit(0.0)).alias(f"m_{c}"), (spread if self.with_std else F.lit(1.0)).alias(f"s_{c}")]
        return df.agg(F.count("*").alias("n"), *parts)

    def fit(self, df: DataFrame, features: Sequence[str]) -> ScalerModel:
        row = self.statistics(df, features).first()
        if not row["n"]:
            raise EmptyDataError("StandardScaler: no rows")
        scale = [1.0 if row[f"s_{c}"] is None or abs(row[f"s_{c}"]) < TINY else float(row[f"s_{c}"]) for c in features]
        return ScalerModel(tuple(features), tuple(float(row[f"m_{c}"] or 0.0) for c in features), tuple(scale))

    def fit_transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        return self.fit(df, features).transform(df)


class MinMaxScaler:
    """To a range, without clipping; a spread under 1e-8 counts as 1."""

    def __init__(self, low: float = 0.0, high: float = 1.0):
        if not low < high:
            raise ValidationError("range", "low must be under high", (low, high))
        self.low, self.high = low, high

    def fit(self, df: DataFrame, features: Sequence[str]) -> ScalerModel:
        check_columns("MinMaxScaler", df, features)
        row = df.agg(F.count("*").alias("n"), *[F.min(num(c)).alias(f"a_{c}") for c in features], *[F.max(num(c)).alias(f"b_{c}") for c in features]).first()
        if not row["n"]:
            raise EmptyDataError("MinMaxScaler: no rows")
        low = [float(row[f"a_{c}"]) for c in features]
        spread = [float(row[f"b_{c}"]) - a for c, a in zip(features, low, strict=True)]
        return ScalerModel(tuple(features), tuple(low), tuple(s if abs(s) >= TINY else 1.0 for s in spread), self.high - self.low, self.low)

    def fit_transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        return self.fit(df, features).transform(df)


@dataclass(frozen=True)
class OneHotModel:
    features: tuple[str, ...]
    categories: tuple[tuple[str, ...], ...]

    def names(self, given: Sequence[str] | None = None) -> list[str]:
        given = given or [f"x{i}" for i in range(len(self.features))]
        return [f"{n}_{c}" for n, cs in zip(given, self.categories, strict=True) for c in cs]

    def transform(self, df: DataFrame, given: Sequence[str] | None = None) -> DataFrame:
        """0 and 1 columns; an unknown or null category is all zeros."""
        names = iter(self.names(given or self.features))
        return df.withColumns({next(names): F.when(F.col(f) == c, 1.0).otherwise(0.0) for f, cs in zip(self.features, self.categories, strict=True) for c in cs})


class OneHotEncoder:
    """Categories are the sorted distinct strings of a column; more than `most` are refused, as each becomes a column."""

    def __init__(self, most: int = 10_000):
        self.most = most

    def categories(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        """feature, category, position. Distinct values are found by a grouped aggregate, not on the driver."""
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).cast("string").alias("category")) for i, f in enumerate(features)])).alias("x")).select("x.*")
        return pairs.where("category is not null").distinct()

    def fit(self, df: DataFrame, features: Sequence[str]) -> OneHotModel:
        rows = self.categories(df, features).limit(self.most + 1).collect()  # bounded by `most`
        if len(rows) > self.most:
            raise ValidationError("features", f"more than {self.most} categories", list(features))
        return OneHotModel(tuple(features), tuple(tuple(sorted((r["category"] for r in rows if r["i"] == i), key=lambda s: s.encode())) for i in range(len(features))))


def task_type(df: DataFrame, target: str) -> str:
    """'classification' if all targets are whole, under 20 differ and at most a quarter of the rows; else 'regression'."""
    y = num(target)
    row = df.agg(F.count("*").alias("n"), F.bool_and(y == F.floor(y)).alias("whole")).first()
    if not row["n"] or not row["whole"]:
        return "regression"
    k = df.select(y.alias("y")).distinct().limit(20).count()
    return "classification" if k < 20 and k <= row["n"] / 4 else "regression"
