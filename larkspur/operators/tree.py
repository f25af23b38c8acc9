"""CART classification trees, grown level by level with exact splits.

A level is one job: rows find their node by the compiled tree so far, class counts by (node, feature, value) are one aggregate,
and split candidates are running sums over the values of a (node, feature). Only each node's best split comes to the driver.
A task sees all distinct values of a feature in a node; with max_bin it sees as many bins (see boosting.bin_edges), whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import EmptyDataError, ValidationError
from ..frame import check_columns, num
from ..functions.numeric import total
from .boosting import bin_edges, bin_of
from .nodes import Ensemble, Node, Tree, expression


def impurity(counts: Sequence[Column], n: Column, criterion: str) -> Column:
    shares = [c / n for c in counts]
    if criterion == "gini":
        return F.lit(1.0) - total([s * s for s in shares])
    return -total([F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in shares])


def candidates(rows: DataFrame, features: Sequence[str], target: str, classes: Sequence[int], criterion: str = "gini", least: int = 1) -> DataFrame:
    """rows(node, features, target) -> node, feature, threshold, gain, left counts l0.., node counts t0..: every midpoint.

    Counts by (node, feature, value) are combined before the shuffle, so a task sees distinct values, not rows.
    """
    k = len(classes)
    long = rows.select("node", target, F.posexplode(F.array(*[num(f) for f in features])).alias("feature", "v"))
    counts = long.groupBy("node", "feature", "v").agg(*[F.sum((F.col(target) == c).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)])
    part = W.partitionBy("node", "feature")
    run = part.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = counts.select("*", F.lead("v").over(part.orderBy("v")).alias("next"), *[F.sum(f"c{i}").over(run).alias(f"l{i}") for i in range(k)], *[F.sum(f"c{i}").over(part).alias(f"t{i}") for i in range(k)])
    left, whole = [F.col(f"l{i}") for i in range(k)], [F.col(f"t{i}") for i in range(k)]
    right = [t - x for t, x in zip(whole, left, strict=True)]
    nl, n = total(left), total(whole)
    nr = n - nl
    gain = impurity(whole, n, criterion) - nl / n * impurity(left, nl, criterion) - nr / n * impurity(right, nr, criterion)
    c = c.where(F.col("next").isNotNull()).where((nl >= least) & (nr >= least))
    return c.select("node", "feature", ((F.col("v") + F.col("next")) / 2).alias("threshold"), F.round(gain, 12).alias("gain"), *[f"l{i}" for i in range(k)], *[f"t{i}" for i in range(k)])


def best_splits(found: DataFrame) -> DataFrame:
    """The best split of each node: greatest gain, then lowest feature, then lowest threshold."""
    cols = [c for c in found.columns if c not in ("node", "gain", "feature", "threshold")]
    best = found.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("nf"), (-F.col("threshold")).alias("nt"), *cols)).alias("x"))
    return best.select("node", (-F.col("x.nf")).alias("feature"), (-F.col("x.nt")).alias("threshold"), F.col("x.gain").alias("gain"), *[F.col(f"x.{c}").alias(c) for c in cols])


class DecisionTreeClassifier:
    def __init__(self, criterion: str = "gini", max_depth: int = 5, min_samples_split: int = 2, min_samples_leaf: int = 1, max_bin: int | None = None):
        if criterion not in ("gini", "entropy"):
            raise ValidationError("criterion", "gini or entropy", criterion)
        if max_bin is not None and max_bin < 2:
            raise ValidationError("max_bin", "2 or more, or None for every value", max_bin)
        self.criterion, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.max_bin = criterion, max_depth, min_samples_split, min_samples_leaf, max_bin

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> TreeModel:
        check_columns("DecisionTreeClassifier", df, features)
        edges = bin_edges(df, features, self.max_bin) if self.max_bin else {}
        seen = [f"__b{i}" for i in range(len(features))] if self.max_bin else list(features)
        bins = [bin_of(num(f), edges[f]).alias(b) for f, b in zip(features, seen, strict=True)] if self.max_bin else []
        rows = df.select(*features, F.col(target).cast("int").alias(target), *bins).persist()
        try:
            counts = {r[target]: r["count"] for r in rows.groupBy(target).count().collect()}
            if not counts:
                raise EmptyDataError("DecisionTreeClassifier: no rows")
            classes = sorted(counts)
            tree = Tree([Node(0, class_counts=[float(counts[c]) for c in classes], count=float(sum(counts.values())))])
            open_nodes = {0}
            for _ in range(self.max_depth):
                open_nodes = {i for i in open_nodes if sum(v > 0 for v in tree.at(i).class_counts) > 1 and tree.at(i).count >= self.min_samples_split}
                if not open_nodes:
                    break
                node = expression(tree, features, lambda n: F.lit(n.node_id))
                at = rows.withColumn("node", node).where(F.col("node").isin(sorted(open_nodes)))
                found = best_splits(candidates(at, seen, target, classes, self.criterion, self.min_samples_leaf)).collect()  # one row for each open node
                open_nodes = set()
                for r in sorted(found, key=lambda r: r["node"]):
                    if r["gain"] > 0:
                        left = [float(r[f"l{i}"]) for i in range(len(classes))]
                        right = [float(r[f"t{i}"]) - v for i, v in enumerate(left)]
                        i, parent = len(tree.nodes), tree.at(r["node"])
                        tree.nodes += [Node(i, class_counts=left, count=sum(left)), Node(i + 1, class_counts=right, count=sum(right))]
                        threshold = edges[features[r["feature"]]][math.floor(r["threshold"])] if self.max_bin else r["threshold"]
                        parent.feature, parent.threshold, parent.gain, parent.left, parent.right = r["feature"], threshold, r["gain"], i, i + 1
                        open_nodes |= {i, i + 1}
        finally:
            rows.unpersist()
        return TreeModel(tuple(features), tuple(classes), tree)


class TreeModel:
    def __init__(self, features: tuple[str, ...], classes: tuple[int, ...], tree: Tree):
        self.features, self.classes, self.tree = features, classes, tree

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        """The most frequent class of the leaf, the first on ties."""
        return df.withColumn(to, expression(self.tree, self.features, lambda n: F.lit(self.classes[max(range(len(self.classes)), key=lambda i: (n.class_counts[i], -i))])))

    def predict_proba(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        return df.withColumns({f"{prefix}{c}": expression(self.tree, self.features, lambda n, i=i: F.lit(n.class_counts[i] / n.count)) for i, c in enumerate(self.classes)})

    def importance(self) -> list[float]:
        """Impurity decrease times rows, by feature, as shares."""
        out = [0.0] * len(self.features)
        for n in self.tree.nodes:
            if not n.leaf:
                out[n.feature] += n.gain * n.count
        whole = sum(out)
        return [v / whole for v in out] if whole else out

    def depth(self) -> int:
        return self.tree.depth()

    def leaves(self) -> int:
        return self.tree.leaves()

    def as_ensemble(self) -> Ensemble:
        return Ensemble(self.features, [self.tree], (0.0,), "classification")
