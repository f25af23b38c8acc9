"""Exceptions and warnings that operators raise."""

from __future__ import annotations


class LarkspurError(Exception):
    pass


class NotFittedError(LarkspurError):
    def __init__(self, model: str, method: str):
        super().__init__(f"{model}: {method} needs a fitted model")


class DimensionError(LarkspurError, ValueError):
    def __init__(self, op: str, expected: object, got: object, axis: int = 1):
        super().__init__(f"{op}: expected {expected}, got {got} on axis {axis}")


class ValidationError(LarkspurError, ValueError):
    def __init__(self, param: str, reason: str, value: object = None):
        super().__init__(f"{param}: {reason} (got {value!r})")


class ModelError(LarkspurError):
    def __init__(self, op: str, kind: str, cause: object = None):
        super().__init__(f"{op}: {kind}" + (f": {cause}" if cause else ""))


class EmptyDataError(LarkspurError, ValueError):
    pass


class SingularMatrixError(LarkspurError, ArithmeticError):
    pass


class NumericalInstabilityError(LarkspurError, ArithmeticError):
    pass


class ConvergenceWarning(UserWarning):
    pass


class DataConversionWarning(UserWarning):
    pass


class UndefinedMetricWarning(UserWarning):
    pass


class ModelDriftWarning(UserWarning):
    pass
