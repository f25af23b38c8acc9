"""Folds, samples and cross-validation. Order comes from a key or a seeded hash, never from rand().

Where an order is by numbers, the first n rows of it are found without a sort: the value of the n-th row comes from a few passes of
bounded bucket counts, and the rows are then told by comparison, wherever they lie. Only orders by other types, and keys that
repeat at the very place of a cut, take positions().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..frame import written
from .linear import LinearRegression

#: Buckets of a pass for each open interval, and intervals counted in one job: together the rows that reach the driver.
BUCKETS, INTERVALS = 1024, 64


def positions(df: DataFrame, order: Sequence, to: str = "pos") -> DataFrame:
    """df with its position (from 1) in a total order, in two levels: ranks within range partitions plus their offsets.

    The ranked rows are written once and both levels read that: a range partitioning that is planned twice may cut otherwise
    the second time. The one-row-for-each-partition totals are the only thing that a single task sees.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inner = written(ranged.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(*order))), "positions")
    sizes = inner.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")).drop("__n")
    return inner.join(F.broadcast(before), "__part").withColumn(to, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


@dataclass
class Place:
    """The value of the row at a rank, the rows below it and those equal to it."""

    value: float | int
    below: int
    equal: int


def places(df: DataFrame, value: Column, ranks: dict, group: str | None = None) -> dict[tuple, Place]:
    """ranks: for each group (None without a group) the ranks wanted, from 1. Values are whole or finite numbers, not null."""
    v = df.select((F.col(group) if group else F.lit(None)).alias("g"), value.alias("v"))
    whole = isinstance(v.schema["v"].dataType, T.IntegralType)
    ends = {r["g"]: (r["lo"], r["hi"]) for r in v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}  # a row for each group
    state = {(g, n): (*ends[g], 0) for g, ns in ranks.items() for n in ns}
    found: dict[tuple, Place] = {}
    while state:
        intervals = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in state.items()}, key=repr)[:INTERVALS]
        at, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (g, lo, hi) in enumerate(intervals):
            inside = (F.col("g").eqNullSafe(F.lit(g)) if group else F.lit(True)) & F.col("v").between(lo, hi)
            if whole and hi - lo < 1 << 53:
                share = F.try_subtract(F.col("v"), F.lit(lo).cast("long")).cast("double") / float(max(hi - lo, 1))
            else:
                share = (F.col("v").cast("double") - float(lo)) / ((float(hi) - float(lo)) or 1.0)
            at = F.when(inside, F.lit(i)).otherwise(at)
            bucket = F.when(inside, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(bucket)
        rows = v.select(at.alias("i"), bucket.alias("b"), "v").where("i is not null").groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # INTERVALS * BUCKETS at most
        counts: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["i"], r["b"])):
            counts.setdefault(r["i"], []).append(r)
        for (g, n), (lo, hi, below) in list(state.items()):
            if (g, lo, hi) not in intervals:
                continue
            for r in counts[intervals.index((g, lo, hi))]:
                if below + r["n"] >= n:
                    break
                below += r["n"]
            if r["lo"] == r["hi"]:
                found[g, n] = Place(r["lo"], below, r["n"])
                del state[g, n]
            else:
                state[g, n] = (r["lo"], r["hi"], below)
    return found


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.FloatType, T.DoubleType))


def first_rows(df: DataFrame, value: Column, key: str, ranks: dict, group: str | None = None) -> dict[tuple, Column] | None:
    """For each group and rank n a condition that holds for the group's first n rows by (value, key); None if no comparison tells them."""
    if not _numeric(df, key):
        return None
    out = {}
    for (g, n), p in places(df, value, ranks, group).items():
        if p.below + p.equal == n:
            out[g, n] = value <= F.lit(p.value)
            continue
        same = df.where((value == F.lit(p.value)) & (F.col(group).eqNullSafe(F.lit(g)) if group else F.lit(True)))
        k = places(same, F.col(key), {None: [n - p.below]})[None, n - p.below]
        if k.below + k.equal != n - p.below:
            return None
        out[g, n] = (value < F.lit(p.value)) | ((value == F.lit(p.value)) & (F.col(key) <= F.lit(k.value)))
    return out


def _edges(n: int, k: int) -> list[int]:
    """Rows before each fold but the first, as far as rows go: the first n % k folds have one row more."""
    size, extra = divmod(n, k)
    ends = [i * size + min(i, extra) for i in range(1, k)]
    return [e for e in ends if 0 < e < n]


def _fold_at(at: Column, size: Column, extra: Column) -> Column:
    """The fold of position at (from 0)."""
    edge = extra * (size + 1)
    return F.when(at < edge, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - edge) / F.greatest(size, F.lit(1)))).cast("int")


def kfold(df: DataFrame, key: str, k: int, seed: int | None = None) -> DataFrame:
    """df with fold: contiguous in key order (or seeded hash order); the first n % k folds have one row more. Null keys get no fold by comparison and come first by position."""
    n = df.count()
    value = F.xxhash64(key, F.lit(seed)) if seed is not None else F.col(key)
    edges = _edges(n, k)
    plain = df.where(F.col(key).isNull()).isEmpty()
    before = first_rows(df, value, key, {None: edges}) if plain and (seed is not None or _numeric(df, key)) else None
    if before is None:
        order = [value, F.col(key)] if seed is not None else [F.col(key)]
        size, extra = divmod(n, k)
        return positions(df, order, "__pos").withColumn("fold", _fold_at(F.col("__pos") - 1, F.lit(size), F.lit(extra))).drop("__pos")
    return df.withColumn("fold", sum(((~before[None, e]).cast("int") for e in edges), F.lit(0)))


def stratified_kfold(df: DataFrame, key: str, target: str, k: int) -> DataFrame:
    """The same rule inside each class."""
    sizes = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count("*").alias("n")).collect()}  # a row for each class
    ranks = {c: _edges(n, k) for c, n in sizes.items()}
    plain = _numeric(df, key) and df.where(F.col(key).isNull()).isEmpty()
    before = first_rows(df, F.col(key), key, ranks, target) if plain else None
    if before is None:
        starts = df.groupBy(target).agg(F.count("*").alias("__n"))
        starts = starts.withColumn("__start", F.sum("__n").over(W.orderBy(target).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n"))
        placed = positions(df, [F.col(target), F.col(key)], "__pos").join(F.broadcast(starts.withColumnRenamed(target, "__c")), F.col(target).eqNullSafe(F.col("__c")))  # a row for each class
        fold = _fold_at(F.col("__pos") - F.col("__start") - 1, F.floor(F.col("__n") / k), F.col("__n") % k)
        return placed.withColumn("fold", fold).drop("__pos", "__start", "__n", "__c")
    fold = F.lit(0)
    for c, ends in ranks.items():
        fold = F.when(F.col(target).eqNullSafe(F.lit(c)), sum(((~before[c, e]).cast("int") for e in ends), F.lit(0))).otherwise(fold)
    return df.withColumn("fold", fold)


def _first(df: DataFrame, value: Column, key: str, n: int) -> DataFrame | Column:
    """A condition for the first n rows, or those rows themselves where no comparison tells them."""
    found = first_rows(df, value, key, {None: [n]})
    return found[None, n] if found is not None else positions(df, [value, F.col(key)], "__pos").where(F.col("__pos") <= n).drop("__pos")


def _taken(df: DataFrame, value: Column, key: str, n: int) -> DataFrame:
    if n <= 0:
        return df.limit(0)
    got = _first(df, value, key, n)
    return df.where(got) if isinstance(got, Column) else got


def bagging(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """int(n * fraction) rows without replacement, in seeded hash order."""
    return _taken(df, F.xxhash64(key, F.lit(seed)), key, int(df.count() * fraction))


def mini_batch(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """The first `size` rows (all, if there are fewer) in seeded hash order."""
    return _taken(df, F.xxhash64(key, F.lit(seed)), key, min(size, df.count()))


def goss(df: DataFrame, key: str, gradient: str, top: float, other: float, seed: int) -> DataFrame:
    """The int(n * top) rows (1 at least) with the largest gradients, and int((n - top rows) * other) of the rest; amplify is their weight.

    A gradient that is null or NaN counts as zero.
    """
    n = df.count()
    n_top = min(n, max(1, int(n * top)))
    n_rest = int((n - n_top) * other)
    if not n:
        return df.withColumn("amplify", F.lit(1.0))
    size, chance, weight = -F.abs(F.coalesce(F.nanvl(F.col(gradient).cast("double"), F.lit(0.0)), F.lit(0.0))), F.xxhash64(key, F.lit(seed)), F.lit((1 - top) / other if other else 0.0)
    large = _first(df, size, key, n_top)
    if isinstance(large, Column):
        small = _first(df.where(~large), chance, key, n_rest) if n_rest else F.lit(False)
        if isinstance(small, Column):
            return df.withColumn("amplify", F.when(large, 1.0).when(small, weight)).where("amplify is not null")
        return df.where(large).withColumn("amplify", F.lit(1.0)).unionByName(small.withColumn("amplify", weight))
    ranked = positions(df, [size, F.col(key)], "__pos")
    rest = positions(ranked.where(F.col("__pos") > n_top).drop("__pos"), [chance, F.col(key)], "__pos").where(F.col("__pos") <= n_rest)
    return ranked.where(F.col("__pos") <= n_top).drop("__pos").withColumn("amplify", F.lit(1.0)).unionByName(rest.drop("__pos").withColumn("amplify", weight))


def cross_validate_with(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], dict[str, float]], seed: int | None = None, target: str | None = None) -> list[dict]:
    """Any estimator: fit(rows of the other folds) -> model, score(model, the fold's rows) -> named values. One row of results for each fold.

    Folds are by key (or seeded hash), within classes where target is given. Folds are independent jobs, k of them.
    """
    if k < 2:
        raise ValueError("k must be 2 or more")
    folds = (stratified_kfold(df, key, target, k) if target else kfold(df, key, k, seed)).persist()
    try:
        out = []
        for f in range(k):
            held = folds.where(F.col("fold") == f).drop("fold")
            if held.isEmpty():
                continue
            out.append({"fold": f, **score(fit(folds.where(F.col("fold") != f).drop("fold")), held)})
        return out
    finally:
        folds.unpersist()


def cross_validate(df: DataFrame, key: str, features: Sequence[str], target: str, k: int) -> list[dict]:
    """Least squares on each fold's complement, scored on the fold: one aggregate for all folds.

    The normal matrix of a complement is the whole less the fold's, and the fold's squared error follows from its own matrix.
    """
    folds = LinearRegression().fit_grouped(kfold(df, key, k), "fold", features, target)
    whole = sum(folds.values())
    out = []
    for f in sorted(folds):
        m = LinearRegression().solve(whole - folds[f], features)
        v = np.array([m.intercept, *m.coefficients, -1.0])
        held = folds[f]
        rss, n = float(v @ held @ v), held[0, 0]
        tss = held[-1, -1] - held[0, -1] ** 2 / n
        out.append({"fold": int(f), "n": int(n), "mse": float(rss / n), "r2": float(1 - rss / tss), "intercept": m.intercept, "coefficients": m.coefficients})
    return out
