"""Schema checks, shipping code to executors, tables written between steps."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DimensionError, NumericalInstabilityError, ValidationError

_SHIPPED: set[str] = set()


def check_columns(op: str, df: DataFrame, columns: Sequence[str]) -> None:
    """All columns must be there and numeric."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DimensionError(op, list(columns), [c for c in columns if c not in missing])
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            raise ValidationError(c, "must be numeric", kind.simpleString())


def num(column: str | Column) -> Column:
    """As double; null becomes NaN nowhere: operators decide."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def guard_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: how many values are null, NaN or infinite. One scan."""
    parts = [F.struct(F.lit(c).alias("column"), F.sum(num(c).isNull().cast("long")).alias("n_null"), F.sum(F.coalesce(F.isnan(num(c)), F.lit(False)).cast("long")).alias("n_nan"), F.sum(F.coalesce(F.abs(num(c)) == float("inf"), F.lit(False)).cast("long")).alias("n_inf")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def guard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, after a check that no value is NaN or infinite."""
    for r in guard_counts(df, columns).collect():  # one row for each column
        if r["n_nan"] or r["n_inf"]:
            raise NumericalInstabilityError(f"{r['column']}: {r['n_nan']} NaN and {r['n_inf']} infinite values")
    return df


def shipped(spark: SparkSession) -> None:
    """Give the package to the executors, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def mapped(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInPandas with a function of this package."""
    shipped(df.sparkSession)
    return df.mapInPandas(function, schema)


#: Shuffle files of a finished query go at once rather than when the JVM next collects its plans.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder for the tables between steps")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="larkspur-"))
    return f"file://{_LOCAL[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; nothing can be deleted any more
        return


_LOCAL: list[str] = []
#: Seconds between two requests to the driver's JVM to collect, and when the last one was.
PAUSE, _LAST = 1.0, [0.0]
_LIVE: dict[str, SparkSession] = {}


@atexit.register
def _delete_all() -> None:
    for path, spark in _LIVE.items():
        _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    A lost executor costs only the unfinished tasks of later jobs. The files go with used(), or when the driver exits.
    """
    spark = df.sparkSession
    settled(spark, PAUSE)
    path = f"{shared_dir(spark).rstrip('/')}/larkspur-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    _LIVE[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def used(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path in _LIVE:
            _delete(_LIVE.pop(path), path)


def settled(spark: SparkSession, pause: float = 0.0) -> None:
    """Ask the driver to let go of the plans of finished queries, which fill its memory; the tables that they broadcast leave the executors with them.

    Nothing is done within `pause` seconds of the last time.
    """
    if time.monotonic() - _LAST[0] >= pause:
        spark.sparkContext._jvm.System.gc()
        _LAST[0] = time.monotonic()


#: Bytes of a batch between the JVM and a Python worker; without it 10,000 rows of any size go at once, and both sides hold them several times.
BATCH, SIZED = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Before a stage: later Python steps of the session get batches of BATCH bytes, if it names no limit of its own, and the executors collect.

    What the stages before left in an executor's JVM it would keep beside the next one's workers. A task for each core reaches them all.
    """
    if spark.conf.get(SIZED, None) is None:
        spark.conf.set(SIZED, str(BATCH))
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()  # one null a task
