"""Boosting: objectives, histograms, splits, whole rounds, prediction, attribution, bundling, model files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators.nodes import Ensemble, Node, Tree, from_json_dump, from_text, to_text
from .estimators import _TF, _TX, _tree_rows
from .registry import frame, ORACLES, query, rnd, rounded, Tables

# Objectives over events: y positive, f a raw score.
_G = "(SELECT event_type, value / 100 + 0.1e0 AS y, (event_id % 11) / 11.0e0 AS f, CAST(event_id % 2 AS DOUBLE) AS b FROM events)"


def _scores(t):
    return t.events.select("event_type", (F.col("value") / 100 + 0.1).alias("y"), ((F.col("event_id") % 11) / F.lit(11.0)).alias("f"), (F.col("event_id") % 2).cast("double").alias("b"))


_GRAD = {
    "l2": ("f - y", "1.0e0"),
    "l1": ("sign(f - y)", "1.0e0"),
    "huber": ("CASE WHEN abs(f - y) <= 0.9e0 THEN f - y ELSE sign(f - y) * 0.9e0 END", "1.0e0"),
    "quantile": ("CASE WHEN f - y < 0 THEN -0.9e0 ELSE 1 - 0.9e0 END", "1.0e0"),
    "fair": ("(f - y) / (abs(f - y) + 1)", "1 / ((abs(f - y) + 1) ** 2)"),
    "poisson": ("exp(f) - y", "exp(f)"),
    "binary": ("1 / (1 + exp(-f)) - b", "1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f)))"),
    "gamma": ("1 - y * exp(-f)", "y * exp(-f)"),
    "tweedie": ("-y * exp(-0.5e0 * f) + exp(0.5e0 * f)", "0.5e0 * y * exp(-0.5e0 * f) + 0.5e0 * exp(0.5e0 * f)"),
}

for _name, (_g, _h) in _GRAD.items():

    @query(f"gradients_{_name}", f"SELECT event_type, round(avg({_g}), 8) + 0.0e0 AS g, round(avg({_h}), 8) + 0.0e0 AS h, round(max({_g}), 8) + 0.0e0 AS top FROM {_G} GROUP BY 1")
    def _gradient(spark, sf_dir, name=_name):
        g, h = B.gradients(name, F.col("b" if name == "binary" else "y"), F.col("f"))
        return _scores(Tables(spark, sf_dir)).groupBy("event_type").agg(rnd(F.avg(g), 8).alias("g"), rnd(F.avg(h), 8).alias("h"), rnd(F.max(g), 8).alias("top"))


_SM = "SELECT event_type, exp(a) / (exp(a) + exp(b) + exp(c)) AS p0, exp(c) / (exp(a) + exp(b) + exp(c)) AS p2, k FROM (SELECT event_type, event_id % 3 AS k, (event_id % 11) / 11.0e0 AS a, value / 100 AS b, 0.3e0 AS c FROM events)"


@query("gradients_multiclass", f"SELECT event_type, round(avg(p0 - CAST(k = 0 AS DOUBLE)), 8) + 0.0e0 AS g0, round(avg(greatest(p0 * (1 - p0), 1e-16)), 8) + 0.0e0 AS h0, round(avg(p2 - CAST(k = 2 AS DOUBLE)), 8) + 0.0e0 AS g2 FROM ({_SM}) GROUP BY 1")
def gradients_multiclass(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    pairs = B.multiclass_gradients(F.col("event_id") % 3, [(F.col("event_id") % 11) / F.lit(11.0), F.col("value") / 100, F.lit(0.3)])
    return e.groupBy("event_type").agg(rnd(F.avg(pairs[0][0]), 8).alias("g0"), rnd(F.avg(pairs[0][1]), 8).alias("h0"), rnd(F.avg(pairs[2][0]), 8).alias("g2"))


_INIT = {
    "mean": ("l2", "y", "avg(y)"),
    "median": ("l1", "y", "quantile_cont(y, 0.5)"),
    "quantile": ("quantile", "y", "quantile_cont(y, 0.9)"),
    "poisson": ("poisson", "y", "ln(avg(y))"),
    "binary": ("binary", "b", "ln(avg(b) / (1 - avg(b)))"),
    "gamma": ("gamma", "y", "ln(avg(y) FILTER (WHERE y > 0))"),
    "tweedie": ("tweedie", "y", "ln(avg(y))"),
}

for _name, (_o, _c, _s) in _INIT.items():

    @query(f"init_score_{_name}", f"SELECT event_type, round({_s}, 8) + 0.0e0 AS start FROM {_G} GROUP BY 1")
    def _init(spark, sf_dir, objective=_o, column=_c):
        return _scores(Tables(spark, sf_dir)).groupBy("event_type").agg(rnd(B.init_score(objective, column), 8).alias("start"))


@query("class_weight_balanced", "SELECT o_orderstatus AS class, n, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * n::DOUBLE), 8) + 0.0e0 AS weight FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def class_weight_balanced(spark, sf_dir):
    return rounded(B.class_weights(Tables(spark, sf_dir).orders, "o_orderstatus"), 8)


_SUMS = f"(SELECT event_type, sum(f - y) AS g, count(*)::DOUBLE AS h FROM {_G} GROUP BY 1)"
_SOFT = "sign(g) * greatest(abs(g) - 2, 0)"


@query("leaf_value", f"SELECT event_type, round(-({_SOFT}) / (h + 1 + 1e-10), 8) + 0.0e0 AS value FROM {_SUMS}")
def leaf_value(spark, sf_dir):
    x = _scores(Tables(spark, sf_dir)).groupBy("event_type").agg(F.sum(F.col("f") - F.col("y")).alias("g"), F.count("*").cast("double").alias("h"))
    return x.select("event_type", rnd(B.leaf_value(F.col("g"), F.col("h"), 2.0, 1.0), 8).alias("value"))


_PAIR = "(SELECT l.event_type, l.g AS gl, l.h AS hl, r.g AS gr, r.h AS hr FROM {s} l, (SELECT sum(g) AS g, sum(h) AS h FROM {s}) r)".format(s=_SUMS)


def _pair(t):
    x = _scores(t).groupBy("event_type").agg(F.sum(F.col("f") - F.col("y")).alias("gl"), F.count("*").cast("double").alias("hl"))
    whole = x.agg(F.sum("gl").alias("gr"), F.sum("hl").alias("hr"))  # one row
    return x.join(F.broadcast(whole), how="cross")


@query("split_gain", f"SELECT event_type, round(0.5e0 * (gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1)), 6) + 0.0e0 AS gain FROM {_PAIR}")
def split_gain(spark, sf_dir):
    return _pair(Tables(spark, sf_dir)).select("event_type", rnd(B.split_gain(F.col("gl"), F.col("hl"), F.col("gr"), F.col("hr"), 0.0, 1.0)).alias("gain"))


def _l1(g: str, h: str) -> str:
    return f"0.5e0 * (greatest(abs({g}) - 2, 0)) ** 2 / ({h} + 1 + 1e-10)"


@query("split_gain_l1", f"SELECT event_type, round({_l1('gl', 'hl')} + {_l1('gr', 'hr')} - {_l1('(gl + gr)', '(hl + hr)')}, 6) + 0.0e0 AS gain FROM {_PAIR}")
def split_gain_l1(spark, sf_dir):
    return _pair(Tables(spark, sf_dir)).select("event_type", rnd(B.split_gain(F.col("gl"), F.col("hl"), F.col("gr"), F.col("hr"), 2.0, 1.0)).alias("gain"))


# Histograms of line items: 50 quantities, 11 discounts.
_HB = "(SELECT CAST(dense_rank() OVER (ORDER BY l_quantity) - 1 AS INT) AS b0, CAST(dense_rank() OVER (ORDER BY l_discount) - 1 AS INT) AS b1, l_extendedprice / 1000 - 30 AS g, l_linestatus FROM lineitem)"
_HIST = f"SELECT 0 AS feature, b0 AS bin, count(*) AS n, sum(g) AS G, count(*)::DOUBLE AS H FROM {_HB} GROUP BY 2 UNION ALL SELECT 1, b1, count(*), sum(g), count(*)::DOUBLE FROM {_HB} GROUP BY 2"


def _binned(t, where="true"):
    df = t.lineitem
    edges = B.bin_edges(df, ["l_quantity", "l_discount"])
    return df.where(where).select(F.lit(0).alias("node"), B.bin_of(F.col("l_quantity"), edges["l_quantity"]).alias("b0"), B.bin_of(F.col("l_discount"), edges["l_discount"]).alias("b1"), (F.col("l_extendedprice") / 1000 - 30).alias("g"), F.lit(1.0).alias("h"), "l_returnflag", "l_linestatus")


def _hist(x):
    return x.select("feature", "bin", "n", rnd("G").alias("G"), rnd("H").alias("H"))


@query("hist_continuous", f"SELECT feature, bin, n, round(G, 6) + 0.0e0 AS G, H FROM ({_HIST})")
def hist_continuous(spark, sf_dir):
    return _hist(B.histogram(_binned(Tables(spark, sf_dir)), ["b0", "b1"]))


@query("hist_subtract", f"SELECT feature, bin, n, round(G, 6) + 0.0e0 AS G, H FROM ({_HIST.replace('FROM ' + _HB, 'FROM (SELECT * FROM ' + _HB + ' WHERE l_linestatus = $$O$$)')})")
def hist_subtract(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _hist(B.hist_subtract(B.histogram(_binned(t), ["b0", "b1"]), B.histogram(_binned(t, "l_linestatus <> 'O'"), ["b0", "b1"])))


_CH = "(SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 10 + CAST(floor(l_discount * 100 + 0.5) AS INT) % 10 AS bin, l_extendedprice / 1000 - 30 AS g FROM lineitem)"


def _cats(t):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select(F.lit(0).alias("node"), (flag * 10 + F.floor(F.col("l_discount") * 100 + 0.5).cast("int") % 10).alias("c"), (F.col("l_extendedprice") / 1000 - 30).alias("g"), F.lit(1.0).alias("h"))


@query("hist_categorical", f"SELECT 0 AS feature, bin, count(*) AS n, round(sum(g), 6) + 0.0e0 AS G, count(*)::DOUBLE AS H FROM {_CH} GROUP BY bin")
def hist_categorical(spark, sf_dir):
    return _hist(B.histogram(_cats(Tables(spark, sf_dir)), ["c"]))


@query("gbt_categorical_split", f"""SELECT round(gain, 3) + 0.0e0 AS gain, categories, n_left FROM (
  SELECT *, 0.5e0 * (gl * gl / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM (
    SELECT sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS gt, sum(h) OVER () AS ht, sum(n) OVER w::BIGINT AS n_left, list_sort(list(bin) OVER w) AS categories, row_number() OVER w AS pos
    FROM (SELECT bin, sum(g) AS g, count(*)::DOUBLE AS h, count(*) AS n FROM {_CH} GROUP BY bin) WINDOW w AS (ORDER BY g / (h + 1 + 1e-10), bin ROWS UNBOUNDED PRECEDING)) WHERE ht > hl) ORDER BY gain DESC, pos LIMIT 1""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def gbt_categorical_split(spark, sf_dir):
    s = B.best(B.category_splits(B.histogram(_cats(Tables(spark, sf_dir)), ["c"]), l2=1.0), "pos")
    return s.select(rnd("gain", 3).alias("gain"), F.array_sort("left").alias("categories"), F.col("nL").alias("n_left"))


@query("bin_boundaries", "SELECT name, count(*) AS n, round(min(e), 6) + 0.0e0 AS first, round(sum(e), 4) + 0.0e0 AS total FROM (SELECT 'l_quantity' AS name, (v + lead(v) OVER (ORDER BY v)) / 2 AS e FROM (SELECT DISTINCT l_quantity AS v FROM lineitem) UNION ALL SELECT 'l_discount', (v + lead(v) OVER (ORDER BY v)) / 2 FROM (SELECT DISTINCT l_discount AS v FROM lineitem)) WHERE e IS NOT NULL GROUP BY name")
def bin_boundaries(spark, sf_dir):
    e = B.bin_edges(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount"])
    return frame(spark, [(f, len(v), v[0], float(sum(v))) for f, v in e.items()], "name string, n long, first double, total double").select("name", "n", rnd("first").alias("first"), rnd("total", 4).alias("total"))


def _splits_sql(where: str = "true", order: str = "gain DESC, feature, bin") -> str:
    return f"""SELECT feature, bin, gain, n_left FROM (SELECT feature, bin, n_left, gl, hl, gt - gl AS gr, ht - hl AS hr, round(0.5e0 * (gl * gl / hl + (gt - gl) ** 2 / (ht - hl) - gt * gt / ht), 9) AS gain
  FROM (SELECT feature, bin, sum(G) OVER w AS gl, sum(H) OVER w AS hl, (sum(n) OVER w)::BIGINT AS n_left, sum(G) OVER (PARTITION BY feature) AS gt, sum(H) OVER (PARTITION BY feature) AS ht FROM ({_HIST}) WINDOW w AS (PARTITION BY feature ORDER BY bin)) WHERE ht - hl >= 1) WHERE {where} ORDER BY {order} LIMIT 1"""


@query("gbt_best_split", f"SELECT feature, bin, round(gain, 3) + 0.0e0 AS gain, n_left FROM ({_splits_sql()})")
def gbt_best_split(spark, sf_dir):
    return B.best(B.bin_splits(B.histogram(_binned(Tables(spark, sf_dir)), ["b0", "b1"]))).select("feature", "bin", rnd("gain", 3).alias("gain"), F.col("nL").alias("n_left"))


@query("gbt_monotone_split", f"SELECT feature, bin, round(gain, 4) + 0.0e0 AS gain, n_left FROM ({_splits_sql('NOT (feature = 0 AND (-gl / (hl + 1e-10)) - (-gr / (hr + 1e-10)) > 0)')})")
def gbt_monotone_split(spark, sf_dir):
    """Feature 0 may only go up: the left leaf must not be above the right one."""
    return B.best(B.bin_splits(B.histogram(_binned(Tables(spark, sf_dir)), ["b0", "b1"]), monotone={0: 1})).select("feature", "bin", rnd("gain", 4).alias("gain"), F.col("nL").alias("n_left"))


# Whole models on orders: a customer's balance, a coarse price and a digit of the key.
_BX = "(SELECT floor(f0 / 500) AS f0, floor(f1 / 5000) AS f1, f2, y, o_orderkey FROM {})".format(_TX)


def _rows(t):
    return _tree_rows(t).select("o_orderkey", F.floor(F.col("f0") / 500).cast("double").alias("f0"), F.floor(F.col("f1") / 5000).cast("double").alias("f1"), "f2", F.col("y").cast("double").alias("y"))


def _boost(t, **params):
    p = {"rounds": 1, "max_depth": 1, "num_leaves": 2, "min_data": 1, "learning_rate": 0.5} | params
    return B.GradientBoosting(**p).fit(_rows(t), _TF, "y", "o_orderkey")


# One round, one split, squared error: the best of all midpoints.
_ROUND = f"""SELECT feature, threshold, n_left, -gl / (hl + 1e-10) * 0.5e0 AS left_value, -(gt - gl) / (ht - hl + 1e-10) * 0.5e0 AS right_value FROM (
  SELECT *, round(0.5e0 * (gl * gl / hl + (gt - gl) ** 2 / (ht - hl) - gt * gt / ht), 9) AS gain, (v + nx) / 2 AS threshold, hl::BIGINT AS n_left FROM (
    SELECT feature, v, lead(v) OVER w AS nx, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM (
      SELECT feature, v, sum(m - y) AS g, count(*)::DOUBLE AS h FROM (SELECT 0 AS feature, f0 AS v, y FROM {_BX} UNION ALL SELECT 1, f1, y FROM {_BX} UNION ALL SELECT 2, f2, y FROM {_BX}), (SELECT avg(y) AS m FROM {_BX}) GROUP BY ALL)
    WINDOW w AS (PARTITION BY feature ORDER BY v)) WHERE nx IS NOT NULL) ORDER BY gain DESC, feature, threshold LIMIT 1"""


@query("gbt_one_round", f"SELECT feature, round(threshold, 6) + 0.0e0 AS threshold, n_left, round(left_value, 8) + 0.0e0 AS left_value, round(right_value, 8) + 0.0e0 AS right_value FROM ({_ROUND})")
def gbt_one_round(spark, sf_dir):
    t = _boost(Tables(spark, sf_dir)).trees[0]
    root, left, right = t.at(0), t.at(t.at(0).left), t.at(t.at(0).right)
    return rounded(frame(spark, [(root.feature, root.threshold, int(left.count), left.value, right.value)], "feature int, threshold double, n_left long, left_value double, right_value double"), 8)


@query("residuals", f"SELECT round(avg((y - m) ** 2), 8) + 0.0e0 AS mse, round(avg(abs(y - m)), 8) + 0.0e0 AS mae, round(sqrt(avg((y - m) ** 2)), 8) + 0.0e0 AS rmse FROM {_BX}, (SELECT avg(y) AS m FROM {_BX})")
def residuals(spark, sf_dir):
    from ..operators import metrics

    t = Tables(spark, sf_dir)
    m = B.GradientBoosting(rounds=1, max_depth=1, min_data=10**9).fit(_rows(t), _TF, "y", "o_orderkey")
    x = m.score(_rows(t)).withColumnRenamed("raw0", "p")
    return rounded(metrics.regression(x, "mse", "mae", "rmse"), 8)


@query("gbt_regression")
def gbt_regression(spark, sf_dir):
    """Loss after each of four rounds; tests hold it against falling."""
    t = Tables(spark, sf_dir)
    rows, losses, booster = _rows(t), [], B.GradientBoosting(rounds=4, max_depth=3, num_leaves=8, min_data=5)
    booster.fit(rows, _TF, "y", "o_orderkey", callback=lambda i, m: losses.append((i, booster.loss(rows, m, "y"))))
    return rounded(frame(spark, losses, "round int, mse double"), 8)


@query("gbt_weighted", f"SELECT round(sum(w * y) / sum(w), 8) + 0.0e0 AS weighted, round(avg(y), 8) + 0.0e0 AS start FROM (SELECT y, CASE WHEN y = 1 THEN 3.0e0 ELSE 1.0e0 END AS w FROM {_BX})")
def gbt_weighted(spark, sf_dir):
    """One leaf with a full step turns the plain mean into the weighted mean."""
    t = Tables(spark, sf_dir)
    rows = _rows(t).withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0))
    m = B.GradientBoosting(rounds=1, max_depth=1, min_data=10**9, learning_rate=1.0).fit(rows, _TF, "y", "o_orderkey", weight="w")
    return rounded(frame(spark, [(m.init[0] + m.trees[0].at(0).value, m.init[0])], "weighted double, start double"), 8)


@query("gbt_init_score", f"SELECT round(avg(y - f2 / 10), 8) + 0.0e0 AS leaf FROM {_BX}")
def gbt_init_score(spark, sf_dir):
    rows = _rows(Tables(spark, sf_dir)).withColumn("i", F.col("f2") / 10)
    m = B.GradientBoosting(rounds=1, max_depth=1, min_data=10**9, learning_rate=1.0).fit(rows, _TF, "y", "o_orderkey", init="i")
    return rounded(frame(spark, [(m.trees[0].at(0).value,)], "leaf double"), 8)


# A fixed ensemble: two trees, one with a default direction.
_FIX = Ensemble(("a", "b"), [
    Tree([Node(0, 0, 25.0, 1, 2, gain=4.0), Node(1, 1, 0.05, 3, 4, gain=2.0, default_left=False), Node(2, value=0.7), Node(3, value=-0.4), Node(4, value=0.1)]),
    Tree([Node(0, 1, 0.02, 1, 2, gain=1.0), Node(1, value=-0.3), Node(2, value=0.25)]),
], (0.2,), "binary")
_T1 = "CASE WHEN a IS NULL OR a <= 25 THEN CASE WHEN b IS NULL THEN 0.1e0 WHEN b <= 0.05e0 THEN -0.4e0 ELSE 0.1e0 END ELSE 0.7e0 END"
_T2 = "CASE WHEN b IS NULL OR b <= 0.02e0 THEN -0.3e0 ELSE 0.25e0 END"
_PX = "(SELECT l_quantity AS a, l_discount AS b, l_returnflag FROM lineitem)"
_NX = "(SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS b, l_returnflag FROM lineitem)"


def _ab(t, gaps=False):
    a, b = F.col("l_quantity"), F.col("l_discount")
    if gaps:
        a, b = F.when(F.col("l_linenumber") != 1, a), F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(b)
    return t.lineitem.select(a.alias("a"), b.alias("b"), "l_returnflag")


@query("gbt_predict", f"SELECT l_returnflag, round(avg(0.2e0 + {_T1} + {_T2}), 8) + 0.0e0 AS raw FROM {_PX} GROUP BY 1")
def gbt_predict(spark, sf_dir):
    return _FIX.score(_ab(Tables(spark, sf_dir))).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


@query("gbt_predict_nan", f"SELECT l_returnflag, round(avg(0.2e0 + {_T1} + {_T2}), 8) + 0.0e0 AS raw FROM {_NX} GROUP BY 1")
def gbt_predict_nan(spark, sf_dir):
    return _FIX.score(_ab(Tables(spark, sf_dir), True)).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


@query("gbt_proba", f"SELECT l_returnflag, round(avg(1 / (1 + exp(-(0.2e0 + {_T1} + {_T2})))), 8) + 0.0e0 AS p FROM {_PX} GROUP BY 1")
def gbt_proba(spark, sf_dir):
    return _ab(Tables(spark, sf_dir)).groupBy("l_returnflag").agg(rnd(F.avg(B.response("binary", _FIX.raw())[0]), 8).alias("p"))


@query("gbt_leaf_index", f"SELECT CASE WHEN a <= 25 THEN CASE WHEN b <= 0.05e0 THEN 3 ELSE 4 END ELSE 2 END AS leaf0, CASE WHEN b <= 0.02e0 THEN 1 ELSE 2 END AS leaf1, count(*) AS n FROM {_PX} GROUP BY ALL")
def gbt_leaf_index(spark, sf_dir):
    return _FIX.leaf_index(_ab(Tables(spark, sf_dir))).groupBy("leaf0", "leaf1").agg(F.count("*").alias("n"))


_MISS = Ensemble(("a", "b"), [Tree([Node(0, 0, 20.0, 1, 2, missing=m, default_left=d), Node(1, value=1.0), Node(2, value=0.0)]) for m, d in (("none", False), ("zero", False), ("nan", False), ("nan", True))])


@query("gbt_missing_policy", "SELECT CAST(sum(CASE WHEN v IS NULL THEN 1 WHEN v <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS as_zero, CAST(sum(CASE WHEN v IS NULL OR v = 0 THEN 0 WHEN v <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS zero_right, CAST(sum(CASE WHEN v IS NULL THEN 0 WHEN v <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS nan_right, CAST(sum(CASE WHEN v IS NULL THEN 1 WHEN v <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS nan_left FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS v FROM lineitem)")
def gbt_missing_policy(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, 0.0).otherwise(F.col("l_quantity"))
    x = _MISS.leaf_index(Tables(spark, sf_dir).lineitem.select(v.alias("a"), F.lit(0.0).alias("b")))
    return x.agg(*[F.sum((F.col(f"leaf{i}") == 1).cast("long")).alias(n) for i, n in enumerate(("as_zero", "zero_right", "nan_right", "nan_left"))])


@query("gbt_importance_split", "SELECT * FROM (VALUES ('a', 0.333333e0), ('b', 0.666667e0)) AS t(feature, importance)")
def gbt_importance_split(spark, sf_dir):
    n = _FIX.table(spark).where("feature >= 0").groupBy("feature").agg(F.count("*").alias("k"))
    whole = n.agg(F.sum("k").alias("w"))  # one row
    return n.join(F.broadcast(whole), how="cross").select(F.get(F.array(*map(F.lit, _FIX.features)), F.col("feature")).alias("feature"), rnd(F.col("k") / F.col("w")).alias("importance"))


@query("gbt_importance_gain", "SELECT * FROM (VALUES ('a', 0.571429e0), ('b', 0.428571e0)) AS t(feature, importance)")
def gbt_importance_gain(spark, sf_dir):
    return rounded(frame(spark, list(zip(_FIX.features, _FIX.importance("gain"), strict=True)), "feature string, importance double"))


@query("gbt_dump", "SELECT * FROM (VALUES (0, 0, 0, 25.0e0, 0.0e0), (0, 1, 1, 0.05e0, 0.0e0), (0, 2, -1, 0.0e0, 0.7e0), (0, 3, -1, 0.0e0, -0.4e0), (0, 4, -1, 0.0e0, 0.1e0), (1, 0, 1, 0.02e0, 0.0e0), (1, 1, -1, 0.0e0, -0.3e0), (1, 2, -1, 0.0e0, 0.25e0)) AS t(tree_id, node_id, feature, threshold, value)")
def gbt_dump(spark, sf_dir):
    return Ensemble.from_json(_FIX.to_json()).table(spark).select("tree_id", "node_id", "feature", "threshold", "value")


_TEXT = """tree
version=v3
num_class=1
objective=regression
feature_names=a b

Tree=0
num_leaves=3
split_feature=0 1
split_gain=4 2
threshold=25 0.05
decision_type=10 8
left_child=1 -1
right_child=-3 -2
leaf_value=-0.4 0.1 0.7
leaf_count=1 1 1

Tree=1
num_leaves=2
split_feature=1
split_gain=1
threshold=0.02
decision_type=10
left_child=-1
right_child=-2
leaf_value=-0.3 0.25
"""
_DUMP = json.dumps({"feature_names": ["a", "b"], "num_class": 1, "objective": "regression", "tree_info": [
    {"tree_structure": {"split_feature": 0, "threshold": 25, "decision_type": "<=", "default_left": True, "missing_type": "NaN", "left_child": {"split_feature": 1, "threshold": 0.05, "decision_type": "<=", "default_left": False, "missing_type": "NaN", "left_child": {"leaf_value": -0.4}, "right_child": {"leaf_value": 0.1}}, "right_child": {"leaf_value": 0.7}}},
    {"tree_structure": {"split_feature": 1, "threshold": 0.02, "decision_type": "<=", "default_left": True, "missing_type": "NaN", "left_child": {"leaf_value": -0.3}, "right_child": {"leaf_value": 0.25}}}]})
_IMPORTED = f"SELECT l_returnflag, round(avg({_T1} + {_T2}), 8) + 0.0e0 AS raw FROM {_NX} GROUP BY 1"


@query("gbt_import_text", _IMPORTED)
def gbt_import_text(spark, sf_dir):
    return from_text(_TEXT).score(_ab(Tables(spark, sf_dir), True)).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


@query("gbt_import_json", _IMPORTED)
def gbt_import_json(spark, sf_dir):
    return from_json_dump(_DUMP).score(_ab(Tables(spark, sf_dir), True)).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


@query("dart_normalize", f"SELECT l_returnflag, round(avg(0.2e0 + 2 * ({_T2})), 8) + 0.0e0 AS raw FROM {_PX} GROUP BY 1")
def dart_normalize(spark, sf_dir):
    return _FIX.normalised([0]).score(_ab(Tables(spark, sf_dir))).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


_M1 = "(0.7e0 - 0.4e0 + 0.1e0) / 3"
_M2 = "(-0.3e0 + 0.25e0) / 2"


@query("gbt_attribution", f"SELECT l_returnflag, round(avg(({_T1} - {_M1}) * CASE WHEN a <= 25 THEN 0.5e0 ELSE 1 END), 8) + 0.0e0 AS a, round(avg(({_T1} - {_M1}) * CASE WHEN a <= 25 THEN 0.5e0 ELSE 0 END + {_T2} - {_M2}), 8) + 0.0e0 AS b FROM {_PX} GROUP BY 1")
def gbt_attribution(spark, sf_dir):
    return _FIX.attribution(_ab(Tables(spark, sf_dir))).groupBy("l_returnflag").agg(rnd(F.avg("a_a"), 8).alias("a"), rnd(F.avg("a_b"), 8).alias("b"))


@query("gbt_interaction", f"SELECT l_returnflag, round(avg(0.1e0 * abs(-0.15e0 - 0.7e0) + CASE WHEN a <= 25 THEN 0.1e0 * abs(-0.4e0 - 0.1e0) ELSE 0 END), 8) + 0.0e0 AS interaction FROM {_PX} GROUP BY 1")
def gbt_interaction(spark, sf_dir):
    return _FIX.interaction(_ab(Tables(spark, sf_dir)), "a", "b").groupBy("l_returnflag").agg(rnd(F.avg("interaction"), 8).alias("interaction"))


# Feature bundling on three sparse columns.
_EX = "(SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS a, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS b, CASE WHEN event_type IN ('view', 'error') THEN value / 2 ELSE 0 END AS c FROM events)"


def _sparse(t):
    k = F.col("event_type")
    return t.events.select("event_id", F.when(k == "click", F.col("value")).otherwise(0.0).alias("a"), F.when(k == "view", F.col("value")).otherwise(0.0).alias("b"), F.when(k.isin("view", "error"), F.col("value") / 2).otherwise(0.0).alias("c"))


@query("efb_sparsity", f"SELECT round(avg(CAST(abs(a) < 1e-10 AS DOUBLE)), 8) + 0.0e0 AS a, round(avg(CAST(abs(b) < 1e-10 AS DOUBLE)), 8) + 0.0e0 AS b, round(avg(CAST(abs(c) < 1e-10 AS DOUBLE)), 8) + 0.0e0 AS c FROM {_EX}")
def efb_sparsity(spark, sf_dir):
    return rounded(_sparse(Tables(spark, sf_dir)).agg(*B.sparsity(None, ["a", "b", "c"])), 8)


def _conf(x: str, y: str) -> str:
    return f"round(count(*) FILTER (WHERE abs({x}) >= 1e-10 AND abs({y}) >= 1e-10) / CAST(nullif(count(*) FILTER (WHERE abs({x}) >= 1e-10 OR abs({y}) >= 1e-10), 0) AS DOUBLE), 8) + 0.0e0 AS {x}__{y}"


@query("efb_conflicts", f"SELECT {_conf('a', 'b')}, {_conf('a', 'c')}, {_conf('b', 'c')} FROM {_EX}")
def efb_conflicts(spark, sf_dir):
    return rounded(_sparse(Tables(spark, sf_dir)).agg(*B.conflicts(["a", "b", "c"])), 8)


@query("efb_bundle", f"SELECT CAST(floor(v / 1000) AS BIGINT) AS slot, count(*) AS n, round(avg(v), 6) + 0.0e0 AS mean FROM (SELECT CASE WHEN abs(a) > 1e-10 THEN 1000 + a WHEN abs(b) > 1e-10 THEN 2000 + b ELSE 0 END AS v FROM {_EX}) GROUP BY 1")
def efb_bundle(spark, sf_dir):
    x = _sparse(Tables(spark, sf_dir)).withColumn("v", B.bundle(["a", "b"]))
    return x.groupBy(F.floor(F.col("v") / 1000).alias("slot")).agg(F.count("*").alias("n"), rnd(F.avg("v")).alias("mean"))


@query("efb_unbundle", f"SELECT round(avg(a), 6) + 0.0e0 AS a, round(avg(b), 6) + 0.0e0 AS b, 0::BIGINT AS wrong FROM {_EX}")
def efb_unbundle(spark, sf_dir):
    x = _sparse(Tables(spark, sf_dir))
    offset = B.bundle_offset(x, ["a", "b"])
    x = x.withColumn("v", B.bundle(["a", "b"], offset))
    back = B.unbundle(F.col("v"), ["a", "b"], offset)
    x = x.select("a", "b", back["a"].alias("a2"), back["b"].alias("b2"))
    return x.agg(rnd(F.avg("a2")).alias("a"), rnd(F.avg("b2")).alias("b"), F.sum(((F.abs(F.col("a") - F.col("a2")) > 1e-9) | (F.abs(F.col("b") - F.col("b2")) > 1e-9)).cast("long")).alias("wrong"))


@query("gbt_text_save", ORACLES["gbt_predict_nan"])
def gbt_text_save(spark, sf_dir):
    """Written as text and read again."""
    return from_text(to_text(_FIX)).score(_ab(Tables(spark, sf_dir), True)).groupBy("l_returnflag").agg(rnd(F.avg("raw0"), 8).alias("raw"))


def _rounds_sql(n: int) -> str:
    """n rounds of one split each: loss of the rows after each of them."""
    out, losses = [f"r0 AS (SELECT f0, f1, f2, y, avg(y) OVER () AS f FROM {_BX})"], []
    for i in range(n):
        sides = " UNION ALL ".join(f"SELECT {k} AS feature, f{k} AS v, y, f FROM r{i}" for k in range(3))
        out.append(f"""s{i} AS (SELECT feature, (v + nx) / 2 AS threshold, -gl / (hl + 1e-10) * 0.5e0 AS lv, -(gt - gl) / (ht - hl + 1e-10) * 0.5e0 AS rv FROM (
  SELECT feature, v, lead(v) OVER w AS nx, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht
  FROM (SELECT feature, v, sum(f - y) AS g, count(*)::DOUBLE AS h FROM ({sides}) GROUP BY ALL) WINDOW w AS (PARTITION BY feature ORDER BY v))
  WHERE nx IS NOT NULL ORDER BY round(0.5e0 * (gl * gl / hl + (gt - gl) ** 2 / (ht - hl) - gt * gt / ht), 9) DESC, feature, threshold LIMIT 1)""")
        out.append(f"r{i + 1} AS (SELECT f0, f1, f2, y, f + CASE WHEN CASE feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END <= threshold THEN lv ELSE rv END AS f FROM r{i}, s{i})")
        losses.append(f"SELECT {i} AS round, round(avg((f - y) ** 2), 8) + 0.0e0 AS mse FROM r{i + 1}")
    return f"WITH {', '.join(out)} {' UNION ALL '.join(losses)}"


@query("gbt_rounds", _rounds_sql(3))
def gbt_rounds(spark, sf_dir):
    """Loss after each of three rounds of one split."""
    t, losses = Tables(spark, sf_dir), []
    rows, booster = _rows(t), B.GradientBoosting(rounds=3, max_depth=1, num_leaves=2, min_data=1, learning_rate=0.5)
    booster.fit(rows, _TF, "y", "o_orderkey", callback=lambda i, m: losses.append((i, booster.loss(rows, m, "y"))))
    return rounded(frame(spark, losses, "round int, mse double"), 8)
