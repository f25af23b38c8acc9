"""Models as one-row Parquet tables, so that any store that Spark writes to can keep them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import ModelError
from ..operators.linear import LinearModel
from ..operators.nodes import Ensemble

KINDS = {"linear": LinearModel, "ensemble": Ensemble}


def save(spark: SparkSession, model: LinearModel | Ensemble, path: str) -> None:
    kind = next((k for k, c in KINDS.items() if isinstance(model, c)), None)
    if kind is None:
        raise ModelError("save", f"unknown model {type(model).__name__}")
    spark.createDataFrame([(kind, model.to_json())], "kind string, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> LinearModel | Ensemble:
    rows = spark.read.parquet(path).limit(2).collect()
    if len(rows) != 1 or rows[0]["kind"] not in KINDS:
        raise ModelError("load", "not a saved model", path)
    return KINDS[rows[0]["kind"]].from_json(rows[0]["model"])
