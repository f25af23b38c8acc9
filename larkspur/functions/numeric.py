"""Numeric column functions: links, safe arithmetic, array algebra. All stay in generated code or array functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"
EXP_MAX = 700.0


def _c(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(D)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def sigmoid(x: Column | str) -> Column:
    """Stable on both sides."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def exp_link(x: Column | str) -> Column:
    """exp with its argument held within the range of doubles."""
    x = _c(x)
    return F.when(x > EXP_MAX, F.exp(F.lit(EXP_MAX))).when(x < -EXP_MAX, F.lit(0.0)).otherwise(F.exp(x))


def log_sum_exp(xs: Sequence[Column]) -> Column:
    top = F.greatest(*[_c(x) for x in xs]) if len(xs) > 1 else _c(xs[0])
    return top + F.log(total([F.exp(_c(x) - top) for x in xs]))


def softmax(xs: Sequence[Column]) -> list[Column]:
    """One column for each score; shifted by the greatest."""
    top = F.greatest(*[_c(x) for x in xs]) if len(xs) > 1 else _c(xs[0])
    parts = [F.exp(_c(x) - top) for x in xs]
    whole = total(parts)
    return [p / whole for p in parts]


def softmax_array(scores: Column) -> Column:
    """The same for an array column of any length."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda v: F.exp(v - top))
    whole = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.transform(parts, lambda v: v / whole)


def argmax(xs: Sequence[Column]) -> Column:
    """Index of the first greatest value."""
    out, best = F.lit(0), _c(xs[0])
    for i, x in enumerate(xs[1:], 1):
        out, best = F.when(_c(x) > best, F.lit(i)).otherwise(out), F.greatest(best, _c(x))
    return out.cast("int")


def safe_divide(a: Column, b: Column, otherwise: float = 0.0, eps: float = 1e-10) -> Column:
    return F.when(F.abs(_c(b)) < eps, F.lit(otherwise)).otherwise(_c(a) / F.when(F.abs(_c(b)) < eps, 1.0).otherwise(_c(b)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(float(low))), F.lit(float(high)))


def clip_norm(xs: Sequence[Column], most: float) -> list[Column]:
    """A gradient scaled down to an L2 norm of at most `most`."""
    norm = F.sqrt(total([_c(x) * _c(x) for x in xs]))
    scale = F.when(norm > most, F.lit(float(most)) / norm).otherwise(F.lit(1.0))
    return [_c(x) * scale for x in xs]


def safe_log(x: Column, eps: float = 1e-15) -> Column:
    return F.log(F.greatest(_c(x), F.lit(eps)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def linear(features: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """intercept + sum of feature * weight, in order."""
    out = F.lit(float(intercept))
    for f, w in zip(features, weights, strict=True):
        out = out + F.col(f).cast(D) * F.lit(float(w))
    return out


def soft_threshold(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(float(l1)), F.lit(0.0))
