"""Trees as flat node tables, compiled to column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError, ValidationError
from ..frame import mapped, num

ZERO = 1e-35


@dataclass
class Node:
    """A split (feature >= 0) or a leaf. x <= threshold, or x in categories, goes left; missing values by missing and default_left."""

    node_id: int
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    value: float = 0.0
    gain: float = 0.0
    count: float = 0.0
    hessian: float = 0.0
    default_left: bool = True
    missing: str = "nan"  # none, zero, nan
    categories: list[int] | None = None
    class_counts: list[float] | None = None

    @property
    def leaf(self) -> bool:
        return self.feature < 0


@dataclass
class Tree:
    nodes: list[Node]

    def at(self, i: int) -> Node:
        return self.nodes[i]

    def depth(self, i: int = 0) -> int:
        n = self.nodes[i]
        return 0 if n.leaf else 1 + max(self.depth(n.left), self.depth(n.right))

    def leaves(self) -> int:
        return sum(n.leaf for n in self.nodes)


def goes_left(n: Node, x: Column) -> Column:
    """Routing of one split; null counts as NaN."""
    x = F.coalesce(x, F.lit(float("nan")))
    if n.categories is not None:
        return ~F.isnan(x) & F.floor(x).cast("int").isin([int(c) for c in n.categories]) if n.categories else F.lit(False)
    below = x <= F.lit(float(n.threshold))
    missing = F.isnan(x)
    if n.missing == "none":  # NaN is read as zero
        return F.when(missing, F.lit(0.0 <= n.threshold)).otherwise(below)
    if n.missing == "zero":
        missing = missing | ((x > -ZERO) & (x <= ZERO))
    return F.when(missing, F.lit(n.default_left)).otherwise(below)


def expression(tree: Tree, features: Sequence[str], leaf, i: int = 0) -> Column:
    """Nested conditions with leaf(node) at the ends."""
    n = tree.at(i)
    if n.leaf:
        return leaf(n)
    return F.when(goes_left(n, num(features[n.feature])), expression(tree, features, leaf, n.left)).otherwise(expression(tree, features, leaf, n.right))


def route(tree: Tree, x: Sequence[float]) -> int:
    """The leaf of one row in plain Python; used where an ensemble is too large for expressions, and in tests."""
    i = 0
    while not tree.at(i).leaf:
        n, v = tree.at(i), x[tree.at(i).feature]
        v = math.nan if v is None else v
        if n.categories is not None:
            left = not math.isnan(v) and math.floor(v) in n.categories
        elif n.missing == "none":
            left = (0.0 if math.isnan(v) else v) <= n.threshold
        elif math.isnan(v) or n.missing == "zero" and -ZERO < v <= ZERO:
            left = n.default_left
        else:
            left = v <= n.threshold
        i = n.left if left else n.right
    return i


#: Beyond this many nodes in all, compiled conditions leave generated code; rows are routed in Arrow batches instead.
COMPILED = 600


@dataclass
class Ensemble:
    """init + sum of leaf values (shrinkage is in the leaves); trees[i] belongs to class i % classes."""

    features: tuple[str, ...]
    trees: list[Tree]
    init: tuple[float, ...] = (0.0,)
    objective: str = "regression"
    params: dict = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.init)

    def raw(self, best: int | None = None) -> list[Column]:
        """One score expression for each class; best: rounds to use."""
        out: list[Column] = [F.lit(float(v)) for v in self.init]
        for i, t in enumerate(self.trees[: None if best is None else best * self.classes]):
            out[i % self.classes] = out[i % self.classes] + expression(t, self.features, lambda n: F.lit(float(n.value)))
        return out

    def score(self, df: DataFrame, prefix: str = "raw") -> DataFrame:
        """df with raw0, raw1, ...: compiled, or routed batch by batch where there are too many nodes."""
        names = [f"{prefix}{k}" for k in range(self.classes)]
        if sum(len(t.nodes) for t in self.trees) <= COMPILED:
            return df.withColumns(dict(zip(names, self.raw(), strict=True)))
        trees, features, init, k = self.trees, list(self.features), self.init, self.classes
        from pyspark.sql import types as T

        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

        def run(batches):
            for b in batches:
                x = b[features].astype(float).to_numpy()
                for j in range(k):
                    b[names[j]] = [init[j] + sum(t.at(route(t, row)).value for t in trees[j::k]) for row in x]
                yield b

        return mapped(df, run, schema)

    def leaf_index(self, df: DataFrame, prefix: str = "leaf") -> DataFrame:
        return df.withColumns({f"{prefix}{i}": expression(t, self.features, lambda n: F.lit(n.node_id)) for i, t in enumerate(self.trees)})

    def importance(self, kind: str = "split") -> list[float]:
        """Shares of splits or gains by feature; another kind gives zeros."""
        out = [0.0] * len(self.features)
        for t in self.trees:
            for n in t.nodes:
                if not n.leaf and kind in ("split", "gain"):
                    out[n.feature] += 1.0 if kind == "split" else n.gain
        whole = sum(out)
        return [v / whole for v in out] if whole > 0 else out

    def table(self, spark: SparkSession) -> DataFrame:
        """The node table."""
        rows = [{"tree_id": i, **asdict(n)} for i, t in enumerate(self.trees) for n in t.nodes]
        schema = "tree_id int, node_id int, feature int, threshold double, left int, right int, value double, gain double, count double, hessian double, default_left boolean, missing string, categories array<int>, class_counts array<double>"
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def to_json(self) -> str:
        return json.dumps({"format": "larkspur-ensemble-1", "features": list(self.features), "init": list(self.init), "objective": self.objective, "params": self.params, "trees": [[asdict(n) for n in t.nodes] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        j = json.loads(text)
        if j.get("format") != "larkspur-ensemble-1":
            raise ValidationError("format", "unknown", j.get("format"))
        return cls(tuple(j["features"]), [Tree([Node(**n) for n in t]) for t in j["trees"]], tuple(j["init"]), j["objective"], j["params"])

    def normalised(self, dropped: Sequence[int]) -> Ensemble:
        """DART: without the dropped trees, the kept ones scaled by n / (n - dropped)."""
        n, gone = len(self.trees), set(dropped)
        scale = n / (n - len(gone)) if len(gone) < n else 1.0
        kept = [Tree([Node(**{**asdict(x), "value": x.value * scale}) for x in t.nodes]) for i, t in enumerate(self.trees) if i not in gone]
        return Ensemble(self.features, kept, self.init, self.objective, self.params)

    def attribution(self, df: DataFrame, prefix: str = "a_") -> DataFrame:
        """df with one column for each feature: for each tree, (leaf - mean leaf) shared evenly over the splits of the path.

        The shares of a row add up to its score less the sum of the trees' mean leaves and the start.
        """
        out = {f: F.lit(0.0) for f in self.features}
        for t in self.trees:
            leaves = [n.value for n in t.nodes if n.leaf]
            mean = sum(leaves) / len(leaves)
            for k, f in enumerate(self.features):
                if any(n.feature == k for n in t.nodes):
                    out[f] = out[f] + self._path_share(t, k, mean, 0, 0, 0)
        return df.withColumns({f"{prefix}{f}": c for f, c in out.items()})

    def _path_share(self, t: Tree, k: int, mean: float, i: int, hits: int, length: int) -> Column:
        n = t.at(i)
        if n.leaf:
            return F.lit((n.value - mean) * hits / length if length else 0.0)
        hits, length = hits + (n.feature == k), length + 1
        return F.when(goes_left(n, num(self.features[n.feature])), self._path_share(t, k, mean, n.left, hits, length)).otherwise(self._path_share(t, k, mean, n.right, hits, length))

    def interaction(self, df: DataFrame, a: str, b: str, to: str = "interaction") -> DataFrame:
        """A tenth of |left value - right value| summed over the splits on a row's path, for trees that use both features."""
        ia, ib = self.features.index(a), self.features.index(b)
        total = F.lit(0.0)

        def mean(t: Tree, i: int) -> float:
            n = t.at(i)
            return n.value if n.leaf else (mean(t, n.left) + mean(t, n.right)) / 2

        def walk(t: Tree, i: int, so_far: float) -> Column:
            n = t.at(i)
            if n.leaf:
                return F.lit(so_far)
            more = so_far + (0.1 * abs(mean(t, n.left) - mean(t, n.right)) if n.feature in (ia, ib) else 0.0)
            return F.when(goes_left(n, num(self.features[n.feature])), walk(t, n.left, more)).otherwise(walk(t, n.right, more))

        for t in self.trees:
            used = {n.feature for n in t.nodes}
            if ia in used and ib in used:
                total = total + walk(t, 0, 0.0)
        return df.withColumn(to, total)


def to_text(model: Ensemble) -> str:
    """The text form that from_text reads. The start score goes into the first tree of each class, as the form has no place for it."""
    head = {"num_class": model.classes, "num_tree_per_iteration": model.classes, "max_feature_idx": len(model.features) - 1, "objective": model.objective, "feature_names": " ".join(model.features)}
    out = ["tree", "version=v4", *(f"{k}={v}" for k, v in head.items()), ""]
    trees = model.trees or [Tree([Node(0)]) for _ in model.init]
    for number, t in enumerate(trees):
        add = model.init[number % model.classes] if number < model.classes else 0.0
        inner, leaves = [n for n in t.nodes if not n.leaf], [n for n in t.nodes if n.leaf]
        place = {n.node_id: i for i, n in enumerate(inner)} | {n.node_id: -i - 1 for i, n in enumerate(leaves)}
        edges, bits, thresholds, kinds = [0], [], [], []
        for n in inner:
            if n.categories is None:
                thresholds.append(repr(float(n.threshold)))
            else:
                thresholds.append(str(len(edges) - 1))
                words = [0] * (max(n.categories, default=0) // 32 + 1)
                for c in n.categories:
                    words[c // 32] |= 1 << c % 32
                bits += words
                edges.append(len(bits))
            kinds.append(int(n.categories is not None) | 2 * n.default_left | ("none", "zero", "nan").index(n.missing) << 2)
        line = lambda name, values: f"{name}={' '.join(map(str, values))}"
        out += [f"Tree={number}", f"num_leaves={len(leaves)}", f"num_cat={len(edges) - 1}"]
        if inner:
            out += [line("split_feature", [n.feature for n in inner]), line("split_gain", [repr(float(n.gain)) for n in inner]), line("threshold", thresholds), line("decision_type", kinds), line("left_child", [place[n.left] for n in inner]), line("right_child", [place[n.right] for n in inner])]
        out += [line("leaf_value", [repr(float(n.value + add)) for n in leaves]), line("leaf_count", [repr(float(n.count)) for n in leaves])]
        if bits:
            out += [line("cat_boundaries", edges), line("cat_threshold", bits)]
        out += ["shrinkage=1", ""]
    return "\n".join([*out, "end of trees", ""])


def _numbers(text: str, kind=float) -> list:
    return [kind(v) for v in text.split()]


def from_text(text: str, features: Sequence[str] | None = None) -> Ensemble:
    """A boosted model in the common text form: a key=value header, then blocks that start with Tree=i; child -k - 1 is leaf k."""
    head, _, body = text.partition("Tree=")
    header = dict(line.split("=", 1) for line in head.splitlines() if "=" in line)
    if "feature_names" not in header and not features:
        raise ModelError("from_text", "no feature_names in the header")
    trees = []
    for block in body.split("Tree=") if body else []:
        f = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
        n_leaves = int(f.get("num_leaves", "1"))
        values = _numbers(f.get("leaf_value", "0"))
        counts = _numbers(f.get("leaf_count", "")) or [0.0] * n_leaves
        if len(values) != n_leaves:
            raise ModelError("from_text", "leaf_value and num_leaves disagree")
        splits = n_leaves - 1
        nodes: list[Node] = []
        if splits:
            cols = _numbers(f["split_feature"], int), _numbers(f["threshold"]), _numbers(f["left_child"], int), _numbers(f["right_child"], int), _numbers(f.get("decision_type", ""), int) or [2] * splits, _numbers(f.get("split_gain", "")) or [0.0] * splits
            edges, bits = _numbers(f.get("cat_boundaries", ""), int), _numbers(f.get("cat_threshold", ""), int)
            child = lambda c: c if c >= 0 else splits - c - 1
            for i, (feature, threshold, left, right, kind, gain) in enumerate(zip(*cols, strict=True)):
                categories = None
                if kind & 1:
                    words = bits[edges[int(threshold)] : edges[int(threshold) + 1]]
                    categories = [32 * w + b for w, word in enumerate(words) for b in range(32) if word >> b & 1]
                nodes.append(Node(i, feature, threshold, child(left), child(right), gain=gain, default_left=bool(kind & 2), missing=("none", "zero", "nan")[kind >> 2 & 3], categories=categories))
        nodes += [Node(splits + i, value=v, count=c) for i, (v, c) in enumerate(zip(values, counts, strict=True))]
        trees.append(Tree(nodes))
    classes = int(header.get("num_class", "1"))
    return Ensemble(tuple(features or header["feature_names"].split()), trees, (0.0,) * classes, header.get("objective", "regression").split()[0])


def from_json_dump(text: str) -> Ensemble:
    """A boosted model in the common nested JSON form (tree_info, tree_structure)."""
    j = json.loads(text)
    trees = []
    for info in j["tree_info"]:
        nodes: list[Node] = []

        def add(n: dict, nodes: list[Node] = nodes) -> int:
            i = len(nodes)
            nodes.append(Node(i))
            if "leaf_value" in n:
                nodes[i] = Node(i, value=float(n["leaf_value"]), count=float(n.get("leaf_count", 0)))
                return i
            categorical = n.get("decision_type") == "=="
            left, right = add(n["left_child"]), add(n["right_child"])
            nodes[i] = Node(i, int(n["split_feature"]), 0.0 if categorical else float(n["threshold"]), left, right, gain=float(n.get("split_gain", 0)), default_left=bool(n.get("default_left", True)), missing={"none": "none", "zero": "zero"}.get(str(n.get("missing_type", "NaN")).lower(), "nan"), categories=[int(c) for c in str(n["threshold"]).split("||")] if categorical else None)
            return i

        add(info["tree_structure"])
        trees.append(Tree(nodes))
    return Ensemble(tuple(j["feature_names"]), trees, (0.0,) * int(j.get("num_class", 1)), str(j.get("objective", "regression")).split()[0])


def pandas_nodes(e: Ensemble) -> pd.DataFrame:
    return pd.DataFrame([{"tree_id": i, **asdict(n)} for i, t in enumerate(e.trees) for n in t.nodes])
