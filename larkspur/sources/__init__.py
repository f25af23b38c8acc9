"""Reading tables, CSV and raw matrices; writing chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionError, ValidationError
from ..frame import mapped

DTYPES = {"float64": "<f8", "float32": "<f4", "int64": "<i8", "int32": "<i4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST")


def raw_matrix(spark: SparkSession, path: str, columns: Sequence[str], dtype: str = "float64") -> DataFrame:
    """A header-less little-endian row-major file (or files), widened to double, with file and row_id.

    Each file is one binary row, so a matrix should come as files of up to some hundred MB; the files are read in parallel.
    """
    if dtype not in DTYPES:
        raise ValidationError("dtype", f"one of {sorted(DTYPES)}", dtype)
    width, code = len(columns), DTYPES[dtype]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                x = np.frombuffer(content, code)
                if len(x) % width:
                    raise DimensionError("raw_matrix", width, len(x) % width)
                x = x.reshape(-1, width).astype(np.float64)
                for i in range(0, len(x), 65_536):
                    part = pd.DataFrame(x[i : i + 65_536], columns=list(columns))
                    part.insert(0, "row_id", range(i, i + len(part)))
                    part.insert(0, "file", name)
                    yield part

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return mapped(files, run, "file string, row_id long, " + ", ".join(f"{c} double" for c in columns))


def rows_between(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows whose key lies in [start, end): pushed down to the scan."""
    return df.where((F.col(key) >= start) & (F.col(key) < end))


def chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk = floor(key / size), for keys that are dense from 0."""
    return df.withColumn("chunk", F.floor(F.col(key) / size).cast("long"))


def write_chunks(df: DataFrame, key: str, size: int, path: str, replace: bool = False) -> None:
    """Rows in folders by chunk. With replace, the chunks that df holds take the place of those at path, and the others stay."""
    out = chunks(df, key, size).write.partitionBy("chunk").mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic" if replace else "static").parquet(path)
