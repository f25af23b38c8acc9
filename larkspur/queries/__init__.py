"""Named queries and their SQL, gathered from one module for each family."""

from . import boosted, estimators, measures, online, preparation, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
