"""Histogram gradient boosting: objectives as column expressions, one aggregate for each tree level.

Features are binned once (midpoints between distinct values where there are at most max_bin of them, else approximate quantiles;
bins are closed on the right). A level's histogram is one grouped sum by (node, feature, bin), combined before the shuffle and
bounded by nodes x features x bins; split search is running sums over bins; the best split of each node comes to the driver.
Categories are split in order of their gradients. Features that are never off their zero bin together share a column of bins.
"""

from __future__ import annotations

import math
import random
import re
import time
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import EmptyDataError, NumericalInstabilityError, ValidationError
from ..frame import check_columns, num, used, written
from ..functions.numeric import sigmoid, soft_threshold, softmax
from .nodes import Ensemble, Node, Tree

# Names of objectives and parameters and the other names that they go by.
OBJECTIVES = {"l2": "l2", "regression": "l2", "regression_l2": "l2", "mse": "l2", "mean_squared_error": "l2", "rmse": "l2", "l1": "l1", "mae": "l1", "mean_absolute_error": "l1", "regression_l1": "l1", "huber": "huber", "quantile": "quantile", "fair": "fair", "poisson": "poisson", "binary": "binary", "binary_logloss": "binary", "logistic": "binary", "gamma": "gamma", "tweedie": "tweedie", "multiclass": "multiclass", "multi_logloss": "multiclass", "softmax": "multiclass"}
NAMES = {
    "rounds": "n_estimators num_iterations num_iteration num_tree num_trees num_round num_rounds num_boost_round n_iter",
    "learning_rate": "shrinkage_rate eta",
    "num_leaves": "num_leaf max_leaves max_leaf",
    "max_depth": "",
    "min_data": "min_child_samples min_data_in_leaf",
    "min_gain": "min_split_gain min_gain_to_split",
    "min_hessian": "min_child_weight min_sum_hessian_in_leaf min_sum_hessian",
    "max_bin": "max_bins",
    "l1": "reg_alpha lambda_l1 l1_regularization",
    "l2": "reg_lambda lambda_l2 l2_regularization lambda",
    "bagging_fraction": "subsample sub_row",
    "bagging_freq": "subsample_freq",
    "feature_fraction": "colsample_bytree sub_feature",
    "node_fraction": "colsample_bynode feature_fraction_bynode",
    "objective": "objective_type app application loss",
    "num_class": "num_classes",
    "boosting": "boosting_type boost",
    "seed": "random_state random_seed data_random_seed",
    "early_stopping": "early_stopping_rounds early_stopping_round n_iter_no_change",
    "categorical": "categorical_feature cat_feature categorical_column cat_column",
    "cat_smooth": "categorical_smooth",
    "cat_l2": "",
    "monotone": "monotone_constraints monotone_constraint",
    "interaction": "interaction_constraints",
    "drop_rate": "rate_drop",
    "max_drop": "max_dropout",
    "skip_drop": "skip_dropout",
    "drop_seed": "",
    "goss_top": "top_rate",
    "goss_other": "other_rate",
    "scale_pos_weight": "",
    "fair_c": "",
    "rho": "tweedie_variance_power",
}
ALIASES = {other: name for name, others in NAMES.items() for other in others.split()}
#: Settings of how a single machine computes; they say nothing about the result and are passed over.
PASSED_OVER = set("n_jobs num_threads num_thread nthread verbosity verbose deterministic force_row_wise force_col_wise device device_type tree_learner tree_type tree num_machines num_machine local_listen_port local_port time_out network_timeout machine_list_file machine_list_filename machine_list mlist importance_type metric metrics metric_types".split())


def snake(name: str) -> str:
    """CamelCase as snake_case."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def canonical(params: dict) -> dict:
    """Parameters under their own names; a name given twice with different values is refused."""
    out: dict = {}
    for k, v in params.items():
        k = k if k in NAMES else snake(k)
        name = ALIASES.get(k, k)
        if name in PASSED_OVER:
            continue
        if name in out and out[name] != v:
            raise ValidationError(name, "given twice", v)
        out[name] = v
    return out


def gradients(objective: str, y: Column, f: Column, alpha: float = 0.9, c: float = 1.0, rho: float = 1.5) -> tuple[Column, Column]:
    """Gradient and hessian of an objective by the raw score f. alpha: quantile or huber width; c: fair; rho: tweedie power."""
    name = OBJECTIVES.get(objective)
    r = f - y
    one = F.lit(1.0)
    if name == "l2":
        return r, one
    if name == "l1":
        return F.signum(r), one
    if name == "huber":
        return F.when(F.abs(r) <= alpha, r).otherwise(F.signum(r) * alpha), one
    if name == "quantile":  # under-prediction costs alpha
        return F.when(r < 0, F.lit(-alpha)).otherwise(F.lit(1 - alpha)), one
    if name == "fair":
        return c * r / (F.abs(r) + c), c * c / ((F.abs(r) + c) * (F.abs(r) + c))
    if name == "poisson":
        return F.exp(f) - y, F.exp(f)
    if name == "binary":
        p = sigmoid(f)
        return p - y, F.greatest(p * (1 - p), F.lit(1e-16))
    if name == "gamma":
        return 1 - y * F.exp(-f), y * F.exp(-f)
    if name == "tweedie":
        return -y * F.exp((1 - rho) * f) + F.exp((2 - rho) * f), -y * (1 - rho) * F.exp((1 - rho) * f) + (2 - rho) * F.exp((2 - rho) * f)
    raise ValidationError("objective", "unknown", objective)


def multiclass_gradients(y: Column, scores: Sequence[Column]) -> list[tuple[Column, Column]]:
    return [(p - (y == k).cast("double"), F.greatest(p * (1 - p), F.lit(1e-16))) for k, p in enumerate(softmax(scores))]


def init_score(objective: str, y: str, alpha: float = 0.9) -> Column:
    """The start of an objective as an aggregate."""
    name, v = OBJECTIVES.get(objective), num(y)
    if name == "l2":
        return F.avg(v)
    if name in ("l1", "huber", "fair"):
        return F.percentile(v, 0.5)
    if name == "quantile":
        return F.percentile(v, alpha)
    if name in ("poisson", "tweedie"):
        return F.log(F.greatest(F.avg(v), F.lit(1e-15)))
    if name == "gamma":
        return F.log(F.avg(F.when(v > 0, v)))
    if name == "binary":
        p = F.least(F.greatest(F.avg(v), F.lit(1e-15)), F.lit(1 - 1e-15))
        return F.log(p / (1 - p))
    raise ValidationError("objective", "unknown", objective)


def response(objective: str, raw: Sequence[Column]) -> list[Column]:
    name = OBJECTIVES.get(objective, objective)
    if name == "binary":
        return [sigmoid(raw[0])]
    if name in ("poisson", "gamma", "tweedie"):
        return [F.exp(raw[0])]
    return softmax(raw) if name == "multiclass" else list(raw)


def leaf_value(g: Column, h: Column, l1: float = 0.0, l2: float = 0.0) -> Column:
    return -soft_threshold(g, l1) / (h + l2 + 1e-10)


def split_score(g: Column, h: Column, l1: float, l2: float) -> Column:
    s = soft_threshold(g, l1) if l1 else g
    return 0.5 * s * s / (h + l2 + (1e-10 if l1 else 0.0))


def split_gain(gl: Column, hl: Column, gr: Column, hr: Column, l1: float = 0.0, l2: float = 0.0) -> Column:
    return split_score(gl, hl, l1, l2) + split_score(gr, hr, l1, l2) - split_score(gl + gr, hl + hr, l1, l2)


def bin_edges(df: DataFrame, features: Sequence[str], max_bin: int = 255) -> dict[str, list[float]]:
    """Upper edges of all bins but the last, for all features in one aggregate of sketches and one of few-valued features' values."""
    if not features:
        return {}
    v = {f: F.when(~F.isnan(num(f)), num(f)) for f in features}
    shares = [i / max_bin for i in range(1, max_bin)] or [0.5]
    sketch = df.agg(*[F.approx_count_distinct(v[f], 0.02).alias(f"n{i}") for i, f in enumerate(features)], *[F.percentile_approx(v[f], shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if sketch[f"n{i}"] <= 1.2 * max_bin + 10]  # well within the sketch's error
    values = df.agg(*[F.collect_set(v[features[i]]).alias(f"v{i}") for i in few]).first() if few else None
    out = {}
    for i, f in enumerate(features):
        if i in few and len(values[f"v{i}"]) <= max_bin:
            have = sorted(values[f"v{i}"])
            out[f] = [(a + b) / 2 for a, b in zip(have, have[1:], strict=False)]
        else:
            out[f] = sorted(set(sketch[f"q{i}"] or []))
    return out


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge at or above x; NaN and null: -1."""
    x = F.coalesce(x, F.lit(float("nan")))
    if not edges:
        return F.when(F.isnan(x), -1).otherwise(0)
    at = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(F.isnan(x), F.lit(-1)).otherwise(F.size(F.filter(at, lambda e: e < x)))


def histogram(rows: DataFrame, bins: Sequence[str]) -> DataFrame:
    """rows(node, bins..., g, h, w) -> node, feature, bin, n, G, H."""
    long = rows.select("node", "g", "h", F.posexplode(F.array(*[F.col(b).cast("int") for b in bins])).alias("feature", "bin"))
    return long.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("g").alias("G"), F.sum("h").alias("H"))


def hist_subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram (feature, bin, n, G, H): parent less child, bins without rows left out."""
    both = parent.select("feature", "bin", "n", "G", "H").unionByName(child.select("feature", "bin", (-F.col("n")).alias("n"), (-F.col("G")).alias("G"), (-F.col("H")).alias("H")))
    return both.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("G").alias("G"), F.sum("H").alias("H")).where("n > 0")


def bin_splits(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 1, min_hessian: float = 1e-16, monotone: dict[int, int] | None = None) -> DataFrame:
    """Every numeric split: node, feature, bin, gain, sums of both sides. Missing values (bin -1) go left."""
    part = W.partitionBy("node", "feature")
    run = part.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = hist.select("node", "feature", "bin", *[F.sum(c).over(run).alias(f"{c}L") for c in ("n", "G", "H")], *[F.sum(c).over(part).alias(f"{c}T") for c in ("n", "G", "H")])
    s = s.withColumns({f"{c}R": F.col(f"{c}T") - F.col(f"{c}L") for c in ("n", "G", "H")})
    s = s.where(f"nL >= {int(min_data)} and nR >= {max(1, int(min_data))} and HL >= {min_hessian} and HR >= {min_hessian} and bin >= 0")
    s = s.withColumn("gain", F.round(split_gain(F.col("GL"), F.col("HL"), F.col("GR"), F.col("HR"), l1, l2), 9))
    for feature, sign in (monotone or {}).items():
        if sign:
            wrong = (leaf_value(F.col("GL"), F.col("HL"), l1, l2) - leaf_value(F.col("GR"), F.col("HR"), l1, l2)) * sign > 0
            s = s.where(~((F.col("feature") == feature) & wrong))
    return s


def category_splits(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 1) -> DataFrame:
    """Splits of categories ordered by G / (H + l2): node, feature, bin (position), gain, sums and the left categories."""
    part = W.partitionBy("node", "feature")
    order = part.orderBy((F.col("G") / (F.col("H") + l2 + 1e-10)), "bin")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = hist.select("node", "feature", F.row_number().over(order).alias("pos"), F.collect_list("bin").over(run).alias("left"), *[F.sum(c).over(run).alias(f"{c}L") for c in ("n", "G", "H")], *[F.sum(c).over(part).alias(f"{c}T") for c in ("n", "G", "H")])
    s = s.withColumns({f"{c}R": F.col(f"{c}T") - F.col(f"{c}L") for c in ("n", "G", "H")}).where(f"nL >= {min_data} and nR >= {max(1, min_data)}")
    return s.withColumn("gain", F.round(split_gain(F.col("GL"), F.col("HL"), F.col("GR"), F.col("HR"), l1, l2), 9))


def ranked_categories(hist: DataFrame, l2: float = 0.0, smooth: float = 0.0) -> DataFrame:
    """hist with pos: the place of a category in order of G / (H + l2 + smooth); missing values (bin -1) come last."""
    order = W.partitionBy("node", "feature").orderBy((F.col("bin") < 0), F.col("G") / (F.col("H") + l2 + smooth + 1e-10), "bin")
    return hist.withColumn("pos", F.row_number().over(order))


def category_running(ranked: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 1, min_hessian: float = 1e-16) -> DataFrame:
    """Splits of ranked categories: node, feature, pos (the last one on the left), gain and sums. Missing values go right."""
    part = W.partitionBy("node", "feature")
    run = part.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = ranked.select("node", "feature", "pos", F.col("bin").alias("__c"), *[F.sum(c).over(run).alias(f"{c}L") for c in ("n", "G", "H")], *[F.sum(c).over(part).alias(f"{c}T") for c in ("n", "G", "H")])
    s = s.withColumns({f"{c}R": F.col(f"{c}T") - F.col(f"{c}L") for c in ("n", "G", "H")})
    s = s.where(f"nL >= {int(min_data)} and nR >= {max(1, int(min_data))} and HL >= {min_hessian} and HR >= {min_hessian} and __c >= 0").drop("__c")
    return s.withColumn("gain", F.round(split_gain(F.col("GL"), F.col("HL"), F.col("GR"), F.col("HR"), l1, l2), 9))


def best(splits: DataFrame, position: str = "bin") -> DataFrame:
    """The best split of each node: greatest gain, then lowest feature, then lowest bin."""
    rest = [c for c in splits.columns if c not in ("node", "gain", "feature", position)]
    x = splits.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("nf"), (-F.col(position)).alias("np"), *rest)).alias("x"))
    return x.select("node", (-F.col("x.nf")).alias("feature"), (-F.col("x.np")).alias(position), F.col("x.gain").alias("gain"), *[F.col(f"x.{c}").alias(c) for c in rest])


class Binned:
    """Rows of bins: a column for each feature, or one for a bundle of features that are never off their zero bin together.

    A category's bin is its whole number; missing values and negative categories have bin -1. A bundle's code is 0 where all of its
    features are in their zero bins, else the place of the one that is not. `cols` are the columns to make, `bin[i]` reads feature i.
    """

    def __init__(self, features: Sequence[str], edges: dict[str, list[float]], categorical: set[int]):
        self.features, self.edges, self.categorical = list(features), edges, categorical
        whole = lambda f: F.floor(F.coalesce(F.when(~F.isnan(num(f)), num(f)), F.lit(-1.0))).cast("int")
        self.raw = [F.greatest(whole(f), F.lit(-1)) if i in categorical else bin_of(num(f), edges[f]) for i, f in enumerate(features)]
        self.groups: list[tuple[int, ...]] = [(i,) for i in range(len(features))]
        self._name()

    def _name(self) -> None:
        self.cols, self.bin, self.codes = {}, [None] * len(self.features), {}
        for g, members in enumerate(self.groups):
            name = f"__b{g}"
            if len(members) == 1:
                self.cols[name], self.bin[members[0]] = self.raw[members[0]], F.col(name)
                continue
            code, at = F.lit(0), 1
            spans = []
            for i in members:
                spans.append((i, at))
                at += len(self.edges[self.features[i]]) + 2  # bins from -1
            for i, start in reversed(spans):
                code = F.when(self.raw[i] != self.zero(i), self.raw[i] + start + 1).otherwise(code)
                size = len(self.edges[self.features[i]]) + 2
                self.bin[i] = F.when(F.col(name).between(start, start + size - 1), F.col(name) - start - 1).otherwise(self.zero(i))
                self.codes[i] = (g, start, size)
            self.cols[name] = code

    def zero(self, i: int) -> int:
        return bisect_left(self.edges[self.features[i]], 0.0)

    def bundle(self, df: DataFrame, most: int = 64) -> None:
        """Put features together that are in their zero bins in 80 % of the rows or more and never off it in the same row.

        Of those, the `most` emptiest are looked at. All rows are counted, so that nothing is lost.
        """
        able = [i for i in range(len(self.features)) if i not in self.categorical]
        if len(able) < 2:
            return
        off = {i: self.raw[i] != self.zero(i) for i in able}
        share = df.agg(*[F.avg(off[i].cast("double")).alias(f"s{i}") for i in able]).first()
        empty = sorted((i for i in able if (share[f"s{i}"] or 0.0) <= 0.2), key=lambda i: (share[f"s{i}"], i))[:most]
        pairs = [(i, j) for n, i in enumerate(empty) for j in empty[n + 1 :]]
        if not pairs:
            return
        meet = df.agg(*[F.max((off[i] & off[j]).cast("int")).alias(f"p{i}_{j}") for i, j in pairs]).first()
        names = {i: f"{i:06d}" for i in empty}
        planned = plan_bundles({names[i]: 1 - share[f"s{i}"] for i in empty}, {(names[i], names[j]): float(meet[f"p{i}_{j}"]) for i, j in pairs})
        together = [tuple(sorted(int(n) for n in b)) for b in planned]
        inside = {i for b in together for i in b}
        self.groups = [b for b in [*((i,) for i in range(len(self.features)) if i not in inside), *together] if b]
        self._name()

    def histogram(self, rows: DataFrame, used: Sequence[int]) -> DataFrame:
        """rows(node, bins, g, h) -> node, feature, bin, n, G, H of the used features."""
        wanted = [g for g, members in enumerate(self.groups) if set(members) & set(used)]
        hist = histogram(rows, [f"__b{g}" for g in wanted])
        hist = hist.withColumn("group", F.get(F.array(*[F.lit(g) for g in wanted]), F.col("feature")))
        single = F.lit(None).cast("int")
        for g in wanted:
            if len(self.groups[g]) == 1:
                single = F.when(F.col("group") == g, self.groups[g][0]).otherwise(single)
        if not self.codes:
            return hist.withColumn("feature", single).drop("group")
        member, first = single, F.lit(0)
        for i, (g, start, size) in self.codes.items():
            here = (F.col("group") == g) & F.col("bin").between(start, start + size - 1)
            member, first = F.when(here, i).otherwise(member), F.when(here, start + 1).otherwise(first)
        sums = ("n", "G", "H")
        told = hist.select("node", "group", member.alias("feature"), (F.col("bin") - first).alias("bin"), *sums)
        own = told.where("feature is not null").drop("group")
        bundled = [i for i in self.codes if i in used]
        whole = told.groupBy("node", "group").agg(*[F.sum(c).alias(f"{c}T") for c in sums])
        zero, of = F.lit(0), F.lit(-1)
        for i in bundled:
            zero, of = F.when(F.col("feature") == i, self.zero(i)).otherwise(zero), F.when(F.col("feature") == i, self.codes[i][0]).otherwise(of)
        every = whole.withColumn("feature", F.explode(F.array(*[F.lit(i) for i in bundled]))).where(of == F.col("group"))
        off = own.groupBy("node", "feature").agg(*[F.sum(c).alias(f"{c}O") for c in sums])
        rest = every.join(off, ["node", "feature"], "left")
        rest = rest.select("node", "feature", zero.alias("bin"), *[(F.col(f"{c}T") - F.coalesce(F.col(f"{c}O"), F.lit(0).cast(whole.schema[f"{c}T"].dataType))).alias(c) for c in sums]).where("n > 0")
        return own.where(F.col("feature").isin(list(used))).unionByName(rest)


@dataclass
class Round:
    """What a callback sees after a round; params may be changed for the next one. Returning True ends the fit."""

    number: int
    rounds: int
    model: Ensemble
    params: dict
    losses: dict[str, float]
    began: float


class GradientBoosting:
    """Boosted trees. Params under their own names or usual aliases (see NAMES).

    The scores so far are a column, written with the rows every KEEP rounds, so that a round costs the same whatever its number.
    Within a tree, only the smaller child of a split is counted; the other is its parent less that.
    """

    DEFAULTS = {"objective": "l2", "rounds": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": 5, "min_data": 20, "min_hessian": 1e-16, "l1": 0.0, "l2": 0.0, "min_gain": 0.0, "max_bin": 255, "feature_fraction": 1.0, "node_fraction": 1.0, "bagging_fraction": 1.0, "bagging_freq": 0, "boosting": "gbdt", "goss_top": 0.2, "goss_other": 0.1, "drop_rate": 0.1, "max_drop": 50, "skip_drop": 0.5, "drop_seed": 4, "alpha": 0.9, "rho": 1.5, "fair_c": 1.0, "seed": 0, "num_class": 1, "monotone": {}, "interaction": (), "categorical": (), "cat_smooth": 0.0, "cat_l2": 0.0, "scale_pos_weight": 1.0, "balanced": False, "bundle": True, "early_stopping": 0}
    KINDS = ("gbdt", "goss", "dart", "rf")
    KEEP = 4

    def __init__(self, **params):
        given = canonical(params)
        unknown = set(given) - set(self.DEFAULTS)
        if unknown:
            raise ValidationError("params", "unknown", sorted(unknown))
        self.p = self.DEFAULTS | given
        if self.p["objective"] not in OBJECTIVES:
            raise ValidationError("objective", "unknown", self.p["objective"])
        if self.p["boosting"] not in self.KINDS:
            raise ValidationError("boosting", " or ".join(self.KINDS), self.p["boosting"])
        if self.p["boosting"] == "rf" and not (self.p["bagging_freq"] and self.p["bagging_fraction"] < 1 or self.p["feature_fraction"] < 1 or self.p["node_fraction"] < 1):
            raise ValidationError("boosting", "rf needs bagging or a fraction of the features", "rf")

    def fit(self, df: DataFrame, features: Sequence[str], target: str, key: str, weight: str | None = None, init: str | None = None, valid: DataFrame | None = None, callback: Callable[[int, Ensemble], bool] | None = None, callbacks: Sequence[Callable[[Round], bool | None]] = ()) -> Ensemble:
        """key orders rows for sampling. init: a column of start scores. callback(round, model) may return True to stop, as may callbacks."""
        p = dict(self.p)
        check_columns("GradientBoosting", df, [*features, target])
        objective = OBJECTIVES[p["objective"]]
        classes = p["num_class"] if objective == "multiclass" else 1
        categorical = {features.index(c) if isinstance(c, str) else int(c) for c in p["categorical"]}
        edges = bin_edges(df, [f for i, f in enumerate(features) if i not in categorical], p["max_bin"])
        binned = Binned(features, edges, categorical)
        if p["bundle"]:
            binned.bundle(df)
        y, start = F.col(target).cast("double"), (0.0,) * classes
        heavy = F.when(y > 0, float(p["scale_pos_weight"])).otherwise(1.0) if objective == "binary" else F.lit(1.0)
        if p["balanced"]:
            counts = {r["y"]: r["count"] for r in df.groupBy(y.alias("y")).count().collect()}  # a row for each class
            for c, k in counts.items():
                heavy = F.when(y == c, sum(counts.values()) / (len(counts) * k)).otherwise(heavy)
        if objective != "multiclass" and not init:
            start = df.select(y.alias("y")).agg(init_score(objective, "y", p["alpha"])).first()[0]
            if start is None:
                raise EmptyDataError("GradientBoosting: no rows")
            start = (float(start),)
        scores = [f"__f{k}" for k in range(classes)]
        begin = [((num(init) if init else F.lit(0.0)) + s).alias(c) for s, c in zip(start, scores, strict=True)]
        base = df.select(key, y.alias("__y"), ((num(weight) if weight else F.lit(1.0)) * heavy).alias("__w"), *begin, *[c.alias(n) for n, c in binned.cols.items()])
        base = written(base, "boosting")
        if base.isEmpty():
            raise EmptyDataError("GradientBoosting: no rows")
        model = Ensemble(tuple(features), [], start, objective, {"edges": {f: len(e) for f, e in edges.items()}})
        grown: list[_Grown] = []
        rows, now = base, [F.col(c) for c in scores]
        best_loss, best_round, began = math.inf, 0, time.monotonic()
        try:
            for it in range(p["rounds"]):
                dropped = self._dropped(p, len(grown) // classes, it)
                lost = [[g.score(binned) for g in (grown[d * classes + k] for d in dropped)] for k in range(classes)]
                seen = [n - sum(x, F.lit(0.0)) if x else n for n, x in zip(now, lost, strict=True)]
                pairs = multiclass_gradients(F.col("__y"), seen) if objective == "multiclass" else [gradients(objective, F.col("__y"), seen[0], p["fair_c"] if objective == "fair" else p["alpha"], p["fair_c"], p["rho"])]
                new = [self._grow(p, rows.withColumns({"g": g * F.col("__w"), "h": h * F.col("__w")}), binned, key, it) for g, h in pairs]
                if dropped:  # the new tree and those left out share what the latter did
                    n = len(dropped)
                    for g in new:
                        g.scale(1 / (n + 1))
                    for d in dropped:
                        for g in grown[d * classes : (d + 1) * classes]:
                            g.scale(n / (n + 1))
                    seen = [s + sum((x * (n / (n + 1)) for x in xs), F.lit(0.0)) for s, xs in zip(seen, lost, strict=True)]
                grown += new
                model.trees += [g.tree for g in new]
                if p["boosting"] != "rf":
                    now = [s + g.score(binned) for s, g in zip(seen, new, strict=True)]
                if (it + 1) % self.KEEP == 0 and it + 1 < p["rounds"] and p["boosting"] != "rf":
                    last, rows = rows, written(rows.select(key, "__y", "__w", *[n.alias(c) for n, c in zip(now, scores, strict=True)], *binned.cols), "boosting")
                    used(last)
                    now = [F.col(c) for c in scores]
                losses = {"valid": self.loss(valid, self._averaged(model, p), target)} if valid is not None else {}
                if losses and p["early_stopping"]:
                    if losses["valid"] < best_loss - 1e-12:
                        best_loss, best_round = losses["valid"], it + 1
                    elif it + 1 - best_round >= p["early_stopping"]:
                        model.trees = model.trees[: best_round * classes]
                        break
                if callback and callback(it, model):
                    break
                if any([c(Round(it, p["rounds"], model, p, losses, began)) for c in callbacks]):
                    break
        finally:
            used(rows, base)
        return self._averaged(model, p)

    @staticmethod
    def _averaged(model: Ensemble, p: dict) -> Ensemble:
        """A forest's trees are averaged, others added."""
        rounds = len(model.trees) // model.classes
        if p["boosting"] != "rf" or rounds < 2:
            return model
        trees = [Tree([replace(n, value=n.value / rounds) for n in t.nodes]) for t in model.trees]
        return Ensemble(model.features, trees, model.init, model.objective, model.params)

    @staticmethod
    def _dropped(p: dict, rounds: int, it: int) -> list[int]:
        """Earlier rounds that this one leaves out (dart)."""
        if p["boosting"] != "dart" or not rounds:
            return []
        r = random.Random(p["drop_seed"] * 1_000_003 + it)
        if r.random() < p["skip_drop"]:
            return []
        n = min(rounds, math.ceil(p["drop_rate"] * rounds), p["max_drop"] if p["max_drop"] > 0 else rounds)
        return sorted(r.sample(range(rounds), n))

    def loss(self, df: DataFrame, model: Ensemble, target: str) -> float:
        objective, y = OBJECTIVES[self.p["objective"]], num(target)
        df = model.score(df, "__raw")
        out = response(objective, [F.col(f"__raw{k}") for k in range(model.classes)])
        if objective == "binary":
            q = F.least(F.greatest(out[0], F.lit(1e-15)), F.lit(1 - 1e-15))
            each = -(y * F.log(q) + (1 - y) * F.log(1 - q))
        elif objective == "multiclass":
            picked = F.get(F.array(*out), y.cast("int"))
            each = -F.log(F.greatest(picked, F.lit(1e-15)))
        else:
            each = (out[0] - y) * (out[0] - y)
        return float(df.agg(F.avg(each)).first()[0])

    @staticmethod
    def _sampled(p: dict, rows: DataFrame, key: str, it: int) -> DataFrame:
        from .selection import bagging, goss

        if p["boosting"] == "goss":
            kept = goss(rows, key, "g", p["goss_top"], p["goss_other"], p["seed"] + it)
            return kept.withColumns({"g": F.col("g") * F.col("amplify"), "h": F.col("h") * F.col("amplify")}).drop("amplify")
        if p["bagging_freq"] and p["bagging_fraction"] < 1:  # the last bag stays between draws
            return bagging(rows, key, p["bagging_fraction"], p["seed"] + it - it % p["bagging_freq"])
        return rows

    @staticmethod
    def _allowed(p: dict, names: Sequence[str], used_features: Sequence[int], path: frozenset[int], node: int, it: int) -> list[int]:
        """Features that a node may be split by: those of its share, and of an interaction set that holds all of its path."""
        able = list(used_features)
        if p["interaction"]:
            sets = [{names.index(f) if isinstance(f, str) else int(f) for f in s} for s in p["interaction"]]
            able = [f for f in able if any(path | {f} <= s for s in sets)]
        if p["node_fraction"] < 1 and able:
            r = random.Random((p["seed"] * 1_000_003 + it) * 1_000_003 + node)
            able = sorted(r.sample(able, max(1, int(len(able) * p["node_fraction"]))))
        return able

    def _grow(self, p: dict, rows: DataFrame, binned: Binned, key: str, it: int) -> _Grown:
        names = binned.features
        rows = self._sampled(p, rows, key, it)
        every = list(range(len(names)))
        if p["feature_fraction"] < 1:
            every = sorted(random.Random(p["seed"] * 1_000_003 + it).sample(every, max(1, int(len(every) * p["feature_fraction"]))))
        monotone = {names.index(f) if isinstance(f, str) else f: s for f, s in (p["monotone"].items() if isinstance(p["monotone"], dict) else enumerate(p["monotone"]))}
        shrink = 1.0 if p["boosting"] == "rf" else p["learning_rate"]
        grown = _Grown(Tree([Node(0)]))
        tree, hist, open_nodes, paths = grown.tree, None, [0], {0: frozenset()}
        for depth in range(p["max_depth"]):
            node = grown.column(binned, lambda n: F.lit(n.node_id))
            if hist is None:
                made = binned.histogram(rows.withColumn("node", F.lit(0)), every)
            else:
                small = [min(pair, key=lambda i: (tree.at(i).count, i)) for pair in open_nodes]
                parent = {a: grown.parent[a] for a, _ in open_nodes}
                counted = binned.histogram(rows.withColumn("node", node).where(F.col("node").isin(small)), every)
                large, of_parent = F.lit(None).cast("int"), F.lit(None).cast("int")
                for (a, b), i in zip(open_nodes, small, strict=True):
                    other = a + b - i
                    large = F.when(F.col("node") == i, other).otherwise(large)
                    of_parent = F.when(F.col("node") == parent[a], other).otherwise(of_parent)
                theirs = hist.select(of_parent.alias("node"), "feature", "bin", "n", "G", "H").where("node is not null")
                less = counted.select(large.alias("node"), "feature", "bin", *[(-F.col(c)).alias(c) for c in ("n", "G", "H")])
                rest = theirs.unionByName(less).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "G", "H")]).where("n > 0")
                made = counted.unionByName(rest)
            last, hist = hist, written(made, "histogram")
            if last is not None:
                used(last)
            plain = [f for f in every if f not in binned.categorical]
            splits = bin_splits(hist.where(F.col("feature").isin(plain)), p["l1"], p["l2"], p["min_data"], p["min_hessian"], monotone)
            kinds = [f for f in every if f in binned.categorical]
            if kinds:
                ranked = ranked_categories(hist.where(F.col("feature").isin(kinds)), p["l2"] + p["cat_l2"], p["cat_smooth"])
                splits = splits.unionByName(category_running(ranked, p["l1"], p["l2"] + p["cat_l2"], p["min_data"], p["min_hessian"]).withColumnRenamed("pos", "bin"))
            if p["interaction"] or p["node_fraction"] < 1:
                ok = F.lit(False)
                for i in [i for pair in open_nodes for i in pair] if depth else [0]:
                    ok = ok | ((F.col("node") == i) & F.col("feature").isin(self._allowed(p, names, every, paths[i], i, it)))
                splits = splits.where(ok)
            found = best(splits).collect()  # a row for each open node
            if depth == 0 and not found:
                s = rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).select(leaf_value(F.col("g"), F.col("h"), p["l1"], p["l2"])).first()[0]
                tree.nodes[0].value = float(s or 0.0) * shrink
                break
            nxt = []
            for r in sorted(found, key=lambda r: (-r["gain"], r["node"])):
                if r["gain"] <= p["min_gain"] or tree.leaves() >= p["num_leaves"]:
                    continue
                f, i, n = int(r["feature"]), len(tree.nodes), tree.at(r["node"])
                for side in "LR":
                    g, h = float(r[f"G{side}"]), float(r[f"H{side}"])
                    soft = math.copysign(max(abs(g) - p["l1"], 0.0), g)
                    tree.nodes.append(Node(len(tree.nodes), value=-soft / (h + p["l2"] + 1e-10) * shrink, count=float(r[f"n{side}"]), hessian=h))
                n.feature, n.left, n.right, n.gain, n.default_left, n.missing = f, i, i + 1, float(r["gain"]), True, "nan"
                if f in binned.categorical:
                    left = ranked.where((F.col("node") == r["node"]) & (F.col("feature") == f) & (F.col("pos") <= r["bin"])).select("bin").collect()  # one feature's categories
                    n.categories, n.default_left = sorted(int(c["bin"]) for c in left if c["bin"] >= 0), False
                    grown.cut[n.node_id] = n.categories
                else:
                    at = edges_of(binned, f)
                    n.threshold = float(at[r["bin"]]) if r["bin"] < len(at) else math.inf
                    grown.cut[n.node_id] = int(r["bin"])
                for child in (i, i + 1):
                    grown.parent[child], paths[child] = n.node_id, paths[n.node_id] | {f}
                nxt.append((i, i + 1))
            open_nodes = nxt
            if not open_nodes:
                break
        used(hist)
        return grown


def edges_of(binned: Binned, feature: int) -> list[float]:
    return binned.edges[binned.features[feature]]


class _Grown:
    """A tree and its cuts in bins."""

    def __init__(self, tree: Tree):
        self.tree, self.cut, self.parent = tree, {}, {}

    def column(self, binned: Binned, leaf, i: int = 0) -> Column:
        n = self.tree.at(i)
        if n.leaf:
            return leaf(n)
        x = binned.bin[n.feature]
        left = x <= self.cut[i] if isinstance(self.cut[i], int) else x.isin(self.cut[i])
        return F.when(left, self.column(binned, leaf, n.left)).otherwise(self.column(binned, leaf, n.right))

    def score(self, binned: Binned) -> Column:
        return self.column(binned, lambda n: F.lit(float(n.value)))

    def scale(self, by: float) -> None:
        for n in self.tree.nodes:
            n.value *= by


def early_stop(values: Sequence[float], patience: int, higher: bool = False) -> int:
    """The best round (from 0) once `patience` rounds bring nothing better, else the best so far."""
    at = 0
    for i, v in enumerate(values):
        if v > values[at] if higher else v < values[at]:
            at = i
        if i - at >= patience:
            break
    return at


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """class, n, weight = rows / (classes * n)."""
    w = W.partitionBy()
    c = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))  # one row for each class
    return c.select("class", "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


# Exclusive feature bundling.

def sparsity(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [F.avg((F.abs(num(f)) < 1e-10).cast("double")).alias(f) for f in features]


def conflicts(features: Sequence[str]) -> list[Column]:
    """For each pair the share of rows where both are nonzero among those where either is."""
    out = []
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            x, y = F.abs(num(a)) >= 1e-10, F.abs(num(b)) >= 1e-10
            out.append((F.sum((x & y).cast("double")) / F.nullif(F.sum((x | y).cast("double")), F.lit(0.0))).alias(f"{a}__{b}"))
    return out


OFFSET = 1000.0


def bundle_offset(df: DataFrame, features: Sequence[str]) -> float:
    """OFFSET, doubled until it is over twice every finite |x|, so that unbundle tells the features apart. One aggregate."""
    size = [F.abs(num(f)) for f in features]
    tops = df.agg(*[F.max(F.when(x < float("inf"), x)).alias(f"x{i}") for i, x in enumerate(size)]).first()  # NaN is greater
    top, offset = max((t for t in tops if t is not None), default=0.0), OFFSET
    while offset / 2 <= top:
        offset *= 2
    if math.isinf(offset * len(features)):
        raise NumericalInstabilityError(f"bundle: values up to {top} leave no room for {len(features)} features in a double")
    return offset


def bundle(features: Sequence[str], offset: float = OFFSET) -> Column:
    """offset * (i + 1) + x for the first nonzero feature i; 0 if none."""
    return F.coalesce(*[F.when(F.abs(num(f)) > 1e-10, F.lit(offset * (i + 1)) + num(f)) for i, f in enumerate(features)], F.lit(0.0))


def unbundle(value: Column, features: Sequence[str], offset: float = OFFSET) -> dict[str, Column]:
    """Inverse of bundle for |x| < offset / 2 (see bundle_offset), to within the rounding of offset * (i + 1) + x."""
    at = F.round(value / offset)
    return {f: F.when((value != 0) & (at == i + 1), value - F.lit(offset * (i + 1))).otherwise(0.0) for i, f in enumerate(features)}


def plan_bundles(share_zero: dict[str, float], conflict: dict[tuple[str, str], float], least: float = 0.8, most: float = 0.0) -> list[list[str]]:
    """Greedy: sparse features, those with the fewest conflicts first, into the first bundle without too many conflicts."""
    sparse = [f for f, s in share_zero.items() if s >= least]
    pair = lambda a, b: conflict.get((a, b), conflict.get((b, a), 0.0))
    out: list[list[str]] = []
    for f in sorted(sparse, key=lambda f: (sum(pair(f, g) > most for g in sparse if g != f), f)):
        for b in out:
            if all(pair(f, g) <= most for g in b):
                b.append(f)
                break
        else:
            out.append([f])
    return out
