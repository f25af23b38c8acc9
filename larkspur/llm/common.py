"""What the operators share: materialised tables in the cluster's shared folder, names, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import BATCH, PAUSE, lean, mapped, settled, shared_dir, shipped, used, written  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> F.Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def everything(df: DataFrame) -> list[F.Column]:
    return [named(c) for c in df.columns]


def appended(df: DataFrame, inputs: list[str], function: Callable, rows: int = 512, **columns: str) -> DataFrame:
    """df with further columns (name: DDL type): function gets a list of values for each input and returns a list for each column.

    The other columns stay Arrow arrays, untouched: a null does not turn whole numbers into floats. The function sees `rows` rows
    at a time, so that its memory does not depend on the size of Spark's batches.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    at = [df.columns.index(c) for c in inputs]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots cannot pass mapInArrow
    schema = widened(plain, **{f"m{i}": kind for i, kind in enumerate(columns.values())})
    kinds = [to_arrow_type(schema[f"m{i}"].dataType) for i in range(len(columns))]
    names = schema.names

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                made = function(*[b.column(i).to_pylist() for i in at])
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, t) for v, t in zip(made, kinds, strict=True)]], names=names)

    shipped(df.sparkSession)
    return plain.mapInArrow(run, schema).toDF(*df.columns, *columns)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df and further columns, given by name and DDL type."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in columns.items())])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: So many edges (16 bytes each) are joined in one task.
FEW_EDGES = 250_000


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) -> node, root: every root takes the smallest one that it meets, until none meets another."""
    edges = [b[["u", "v"]].to_numpy() for b in batches if len(b)]
    if not edges:
        return
    edges = np.concatenate(edges)
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(edges.shape).T
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(rest), 100_000):
        yield pd.DataFrame({"node": nodes[rest[i : i + 100_000]], "root": nodes[root[rest[i : i + 100_000]]]})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u, v) long -> (node, root): the smallest node of each connected component, for its other nodes.

    Up to FEW_EDGES distinct edges are joined in one task: a round of steps over a small graph costs tasks, not work. More of them take
    alternating large-star and small-star steps. Every step is a grouped minimum (combined before the shuffle) and a join
    that Spark may split where a node has very many neighbours. The edges live in written tables, never on the driver.
    """
    cur = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur, before = written(cur, name), None
    if cur.count() <= FEW_EDGES:
        return mapped(cur.coalesce(1), joined, "node long, root long")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur, last = written(small, name), cur
        used(last)
        now = tuple(cur.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == before:
            return cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
