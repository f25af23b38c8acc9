import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import errors
from larkspur.frame import guard
from larkspur.operators import boosting as B
from larkspur.operators import cluster, metrics, selection
from larkspur.operators.folds import ADWIN, DDM, PassiveAggressive, SGDRegressor
from larkspur.operators.linear import LinearModel, LinearRegression, LogisticRegression
from larkspur.operators.nodes import Ensemble, Node, Tree, route
from larkspur.operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler
from larkspur.operators.tree import DecisionTreeClassifier
from larkspur.plans.persist import load, save
from larkspur.plans.pipeline import Pipeline
from larkspur.sources import raw_matrix


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scaler_fixture(spark):
    df = frame(spark, [(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "x0 double, x1 double")
    m = StandardScaler().fit(df, ["x0", "x1"])
    assert m.shift == (2.0, 5.0) and m.scale[0] == pytest.approx(0.816496580927726)
    back = m.inverse_transform(m.transform(df)).orderBy("x0").collect()
    assert [r["x0"] for r in back] == pytest.approx([1, 2, 3])


def test_constant_column_scales_by_one(spark):
    df = frame(spark, [(7.0,), (7.0,)], "x double")
    assert StandardScaler().fit(df, ["x"]).scale == (1.0,) and MinMaxScaler().fit(df, ["x"]).scale == (1.0,)


def test_empty_and_wrong_input_raise(spark):
    empty = frame(spark, [], "x double, y double")
    for f in (lambda: StandardScaler().fit(empty, ["x"]), lambda: LinearRegression().fit(empty, ["x"], "y"), lambda: metrics.score(empty, "r2", "x", "y")):
        with pytest.raises(errors.EmptyDataError):
            f()
    with pytest.raises(errors.DimensionError):
        StandardScaler().fit(empty, ["z"])
    with pytest.raises(errors.NumericalInstabilityError):
        guard(frame(spark, [(float("inf"),)], "x double"), ["x"])
    with pytest.raises(errors.NotFittedError):
        Pipeline([("a", StandardScaler())]).transform(empty)
    with pytest.raises(errors.ValidationError):
        LogisticRegression(penalty="l1")


def test_singular(spark):
    df = frame(spark, [(1.0, 2.0, 1.0), (2.0, 4.0, 2.0), (3.0, 6.0, 3.5)], "a double, b double, y double")
    with pytest.raises(errors.SingularMatrixError):
        LinearRegression().fit(df, ["a", "b"], "y")


def test_onehot_fixture(spark):
    df = frame(spark, [("cat", "red"), ("dog", "blue"), ("cat", "green")], "animal string, color string")
    m = OneHotEncoder().fit(df, ["animal", "color"])
    assert m.names() == ["x0_cat", "x0_dog", "x1_blue", "x1_green", "x1_red"]
    unknown = m.transform(frame(spark, [("cow", None)], "animal string, color string")).first()
    assert sum(unknown[c] for c in m.names(["animal", "color"])) == 0
    with pytest.raises(errors.ValidationError):
        OneHotEncoder(most=1).fit(df, ["animal"])


def test_metric_fixtures(spark):
    p = frame(spark, [(1.0, 1.5), (2.0, 2.5), (3.0, 2.5), (4.0, 3.5)], "y double, p double")
    assert metrics.score(p, "mse") == pytest.approx(0.25)
    a = frame(spark, [(0.0, 0.1), (0.0, 0.4), (1.0, 0.35), (1.0, 0.8)], "y double, score double")
    assert metrics.auc(a).first()[0] == pytest.approx(0.75)
    assert metrics.auc(a.where("y = 1")).first()[0] == 0.5
    with pytest.raises(errors.ValidationError):
        metrics.check_binary(frame(spark, [(2.0,)], "y double"))


def test_ndcg_by_hand(spark):
    rel, score = [3, 2, 3, 0, 1, 2], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    n = frame(spark, [(1, r, s, i) for i, (r, s) in enumerate(zip(rel, score, strict=True))], "query int, rel int, score double, key int")
    gain = lambda rs: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rs))
    assert metrics.ndcg(n).first()["ndcg"] == pytest.approx(gain(rel[::-1]) / gain(sorted(rel, reverse=True)))
    assert metrics.average_precision(n.withColumn("rel", F.lit(0))).first()["ap"] == 0


def test_row_order_and_partitions_do_not_matter(spark):
    df = spark.range(500).select((F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"), "id")
    a = LinearRegression().fit(df, ["x"], "y")
    b = LinearRegression().fit(df.repartition(7).orderBy(F.col("id").desc()), ["x"], "y")
    assert a.coefficients == pytest.approx(b.coefficients) and a.intercept == pytest.approx(b.intercept)
    one = sorted(map(tuple, selection.kfold(df, "id", 3, seed=4).select("id", "fold").collect()))
    two = sorted(map(tuple, selection.kfold(df.repartition(9), "id", 3, seed=4).select("id", "fold").collect()))
    assert one == two


def test_model_files(spark, tmp_path):
    m = LinearModel(("a", "b"), (2.0, 3.0), 1.0)
    save(spark, m, str(tmp_path / "m"))
    assert load(spark, str(tmp_path / "m")) == m
    bad = json.loads(m.to_json())
    bad["params"]["coefficients"][0] = 9.0
    with pytest.raises(errors.ValidationError):
        LinearModel.from_json(json.dumps(bad))
    bad["model_spec"]["format_version"] = "2.0"
    with pytest.raises(errors.ValidationError):
        LinearModel.from_json(json.dumps(bad))
    with pytest.raises(errors.ModelError):
        LinearModel.from_json("{}")


def test_sgd_line(spark):
    df = spark.range(2000).select(F.lit(0).alias("k"), "id", ((F.col("id") * 37 % 100) / 100.0).alias("x")).withColumn("y", 2 * F.col("x") + 1)
    r = SGDRegressor(eta0=0.5, learning_rate="constant").fit_keys(df, "k", "id", ["x"], "y").first()
    assert r["w0"] == pytest.approx(2, abs=0.1) and r["intercept"] == pytest.approx(1, abs=0.1)
    p = PassiveAggressive(epsilon=0.01).fit_keys(df, "k", "id", ["x"], "y").first()
    assert p["w0"] == pytest.approx(2, abs=0.2)


def test_huber_gradient_and_unknown_names():
    from larkspur.operators.folds import _loss_slope, _margin_slope

    assert _loss_slope("huber", 5.0, 0.0, 0.1) == 0.1 and _loss_slope("epsilon_insensitive", 0.05, 0.0, 0.1) == 0
    assert _margin_slope("log_loss", -1.0) == pytest.approx(-1 / (1 + math.exp(-1)))  # right for negative margins
    with pytest.raises(errors.ValidationError):
        SGDRegressor("nope")


def test_drift_detectors():
    d, s = DDM(), DDM().init()
    r = np.random.Generator(np.random.PCG64(1))
    states = [d.update(s, bool(v > 0.05)) for v in r.random(3000)]
    before = s[5]
    states = [d.update(s, bool(v > 0.5)) for v in r.random(3000)]
    assert s[5] > before and "drift" in states
    a, w = ADWIN(), [[], 0]
    for v in [0.0] * 300 + [1.0] * 300:
        a.update(w, v)
    assert w[1] >= 1 and all(b[0] <= 2 for b in w[0])


def test_tree_fixture(spark):
    rows = [(0.0, 0.0, 0), (0.1, 0.2, 0), (0.2, 0.1, 0), (0.3, 0.3, 0), (1.0, 1.0, 1), (1.1, 1.2, 1), (1.2, 1.1, 1), (1.3, 1.3, 1)]
    df = frame(spark, rows, "x0 double, x1 double, y int")
    for criterion in ("gini", "entropy"):
        m = DecisionTreeClassifier(criterion).fit(df, ["x0", "x1"], "y")
        assert m.depth() == 1 and m.leaves() == 2 and m.importance() == [1.0, 0.0]
        assert m.tree.at(0).threshold == pytest.approx(0.65)
        assert m.predict(df).where("prediction <> y").count() == 0
        assert m.predict_proba(df).where("abs(p_0 + p_1 - 1) > 1e-12").count() == 0


def test_boosting_options(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") * 13 % 7).cast("double").alias("z")).withColumn("y", F.col("x") * 3 + F.col("z"))
    fit = lambda **p: B.GradientBoosting(**({"rounds": 3, "max_depth": 2, "min_data": 5} | p)).fit(df, ["x", "z"], "y", "id")
    m = fit()
    assert len(m.trees) == 3 and sum(m.importance()) == pytest.approx(1)
    back = Ensemble.from_json(m.to_json())
    assert back.to_json() == m.to_json()
    up = fit(monotone={0: 1})
    pred = up.score(df).groupBy("x").agg(F.avg(F.col("raw0")).alias("p")).orderBy("x").collect()
    assert all(a["p"] <= b["p"] + 1e-9 for a, b in zip(pred, pred[1:], strict=False))
    assert fit(boosting="goss").trees and fit(bagging_fraction=0.5, bagging_freq=2).trees and fit(feature_fraction=0.5).trees
    b3 = B.GradientBoosting(objective="multiclass", num_class=3, rounds=2, max_depth=2, min_data=5).fit(df.withColumn("y", (F.col("x") % 3).cast("double")), ["x", "z"], "y", "id")
    assert len(b3.trees) == 6 and b3.classes == 3
    early = B.GradientBoosting(rounds=30, max_depth=1, learning_rate=3.0, early_stopping=2, min_data=5).fit(df, ["x", "z"], "y", "id", valid=df)
    assert len(early.trees) < 30
    with pytest.raises(errors.ValidationError):
        B.GradientBoosting(nope=1)
    assert B.canonical({"reg_lambda": 1.0})["l2"] == 1.0
    assert B.early_stop([3, 2, 1, 2, 3, 4], 2) == 2


def test_routing_agrees_with_expressions(spark):
    t = Tree([Node(0, 0, 1.0, 1, 2, missing="zero", default_left=False), Node(1, value=1.0), Node(2, 1, 0.0, 3, 4, categories=[1, 3]), Node(3, value=2.0), Node(4, value=3.0)])
    e = Ensemble(("a", "b"), [t])
    rows = [(a, b) for a in (0.0, 0.5, 1.0, 2.0, None, float("nan")) for b in (0.0, 1.0, 3.0, 3.5, None)]
    got = e.score(frame(spark, rows, "a double, b double")).collect()
    assert [r["raw0"] for r in got] == [t.at(route(t, (r["a"], r["b"]))).value for r in got]


def test_large_ensembles_are_routed(spark):
    t = Tree([Node(0, 0, 0.5, 1, 2), Node(1, value=1.0), Node(2, value=-1.0)])
    e = Ensemble(("a",), [t] * 300)
    assert [r["raw0"] for r in e.score(frame(spark, [(0.0,), (1.0,)], "a double")).collect()] == [300.0, -300.0]


def test_kmeans(spark):
    df = frame(spark, [(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(40)], "id int, e array<double>")
    c = sorted(cluster.KMeans(2).fit(df, "e", "id").tolist())
    assert c[0][0] == pytest.approx(0.19, abs=0.01) and c[1][0] == pytest.approx(10.2, abs=0.01)


def test_raw_matrix(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "m.bin")
    out = raw_matrix(spark, str(tmp_path / "m.bin"), ["a", "b", "c"], "float32").orderBy("row_id").collect()
    assert [(r["a"], r["c"]) for r in out] == [(0.0, 2.0), (3.0, 5.0), (6.0, 8.0), (9.0, 11.0)]


def test_unbundle_takes_values_of_any_size(spark):
    rows = [(560.25, 0.0), (0.0, 1234.5), (0.0, -750.0), (-3e5, 0.0), (0.0, 0.0), (None, 2.0), (float("nan"), 0.0)]
    df = frame(spark, rows, "a double, b double")
    offset = B.bundle_offset(df, ["a", "b"])
    assert B.bundle_offset(df.where("a = 0 and b = 0"), ["a", "b"]) == B.bundle_offset(df.where("false"), ["a", "b"]) == B.OFFSET
    back = B.unbundle(F.col("v"), ["a", "b"], offset)
    got = df.withColumn("v", B.bundle(["a", "b"], offset)).select("a", "b", back["a"].alias("a2"), back["b"].alias("b2")).collect()
    assert all((r["a2"], r["b2"]) == pytest.approx((r["a"] or 0.0, r["b"]), abs=1e-9) for r in got if r["a"] is None or not math.isnan(r["a"]))
    with pytest.raises(errors.NumericalInstabilityError):
        B.bundle_offset(frame(spark, [(1e308, 0.0)], "a double, b double"), ["a", "b"])


def test_bundles():
    share = {"a": 0.9, "b": 0.9, "c": 0.1, "d": 0.95}
    assert B.plan_bundles(share, {("a", "b"): 0.0, ("a", "d"): 0.5, ("b", "d"): 0.0}) in ([["b", "a"], ["d"]], [["b", "d"], ["a"]], [["b", "a"], ["d"]])


def test_keyed_drift_stream(spark, tmp_path):
    from larkspur import streaming as S

    path = str(tmp_path / "in")
    spark.range(400).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), (F.col("id") % 10 != 0).alias("ok")).repartition(2).write.parquet(path)
    s = S.ddm_stream(S.file_stream(spark, path), "k", "t", "ok")
    q = s.writeStream.format("memory").queryName("drift_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("drift_out").groupBy("k").agg(F.max("n").alias("n")).orderBy("k").collect()[0]["n"] > 0


def test_windowed_stream(spark, tmp_path, sf_dir):
    from larkspur import streaming as S

    path = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(path)
    w = S.windowed(S.file_stream(spark, path), "ts", "1 day", "1 hour", n=F.count("*"))
    w.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_positions_over_many_wide_rows(spark):
    """2M rows with a text, many partitions, adaptive execution: every place once, whatever the second reading would have made of them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(2_000_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.col("id").cast("string"), 8).alias("text"))
        out = selection.positions(df, [F.col("k"), F.col("id")])
        got = out.agg(F.count("*"), F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.sum("pos")).first()
        n = 2_000_000
        assert tuple(got) == (n, 1, n, n, n * (n + 1) // 2)
        folds = [r["count"] for r in selection.kfold(df, "id", 5, seed=1).groupBy("fold").count().collect()]
        assert folds == [400_000] * 5
        assert selection.bagging(df, "id", 0.3, 2).count() == 600_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_rows_against_sorting(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice([0.0, 0.5, -0.5, r.gauss(0, 1) * 10 ** r.randrange(-3, 9)]), "ab"[i % 7 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g double, c string").repartition(5)
    ranks = [1, 2, 700, 1500, 2999, 3000]
    order = [i for i, _, _ in sorted(rows, key=lambda x: (-abs(x[1]), x[0]))]
    for (_, n), cond in selection.first_rows(df, -F.abs("g"), "id", {None: ranks}).items():
        assert {x["id"] for x in df.where(cond).collect()} == set(order[:n])
    top = selection.goss(df, "id", "g", 0.1, 0.2, 3).collect()
    assert {x["id"] for x in top if x["amplify"] == 1.0} == set(order[:300]) and len(top) == 300 + 540
    for c, k in (("a", 4), ("b", 4)):
        got = sorted((x["id"], x["fold"]) for x in selection.stratified_kfold(df, "id", "c", k).where(F.col("c") == c).collect())
        n, want = len(got), []
        for f in range(k):
            want += [f] * (n // k + (f < n % k))
        assert [f for _, f in got] == want
    text = df.withColumn("name", F.format_string("n%06d", "id"))  # orders that are no numbers take the ranked rows
    for got in (selection.kfold(text, "name", 7), selection.kfold(df.withColumn("name", F.lit(1)), "name", 7)):
        assert sorted(x["count"] for x in got.groupBy("fold").count().collect()) == [428, 428, 428, 429, 429, 429, 429]
    assert selection.mini_batch(df, "id", 10, 1).count() == 10 and selection.mini_batch(df, "id", 10**6, 1).count() == 3000
    assert selection.kfold(df.limit(0), "id", 3).count() == 0 and selection.goss(df.limit(0), "id", "g", 0.1, 0.1, 1).count() == 0


def test_cross_validate_any_estimator(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) * 2 + F.col("id") % 3).cast("double").alias("y"))
    own = selection.cross_validate_with(df, "id", 4, lambda d: LinearRegression().fit(d, ["x"], "y"), lambda m, d: {"r2": m.score(d, "y"), "n": d.count()})
    fast = selection.cross_validate(df, "id", ["x"], "y", 4)
    assert [r["n"] for r in own] == [15] * 4 and [r["r2"] for r in own] == pytest.approx([r["r2"] for r in fast])


def test_boosting_kinds(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("c"), F.when(F.col("id") % 10 == 3, F.col("id") % 4).otherwise(0).cast("double").alias("s"), F.when(F.col("id") % 10 == 7, F.col("id") % 6).otherwise(0).cast("double").alias("t"))
    df = df.withColumn("y", F.col("x") / 10 + F.when(F.col("c").isin(1.0, 4.0), 3.0).otherwise(0.0) + F.col("s") - F.col("t"))
    features = ["x", "c", "s", "t"]
    fit = lambda **p: B.GradientBoosting(**({"max_depth": 3, "min_data": 2, "rounds": 2, "learning_rate": 0.5} | p)).fit(df, features, "y", "id")
    mse = lambda m: m.score(df).agg(F.avg((F.col("raw0") - F.col("y")) ** 2)).first()[0]
    nodes = lambda m: [(n.feature, n.threshold, n.left, n.right, n.count, round(n.value, 6)) for t in m.trees for n in t.nodes]
    plain = fit(bundle=False)
    assert nodes(fit()) == nodes(plain)  # bundles change nothing
    cat = fit(categorical=["c"])
    assert next(n for n in cat.trees[0].nodes if not n.leaf).categories in ([0, 2, 3], [1, 4]) and mse(cat) < mse(plain)
    dart = fit(boosting="dart", drop_rate=0.5, skip_drop=0.0, rounds=3)
    assert len(dart.trees) == 3 and mse(dart) < df.agg(F.var_pop("y")).first()[0]
    forest = fit(boosting="rf", bagging_freq=1, bagging_fraction=0.7)
    assert len(forest.trees) == 2 and mse(forest) < df.agg(F.var_pop("y")).first()[0]
    only = fit(interaction=[["x", "c"], ["s"], ["t"]], rounds=1)
    for t in only.trees:
        for n in t.nodes:
            for child in (n.left, n.right):
                if not n.leaf and not t.at(child).leaf:
                    assert {n.feature, t.at(child).feature} <= {0, 1} or n.feature == t.at(child).feature


def test_boosting_over_many_rounds(spark):
    import time

    df = spark.range(2000).select("id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 31).cast("double").alias("z")).withColumn("y", F.sin("x") + F.col("z") / 10)
    times, began = [], time.monotonic()

    def note(r):
        nonlocal began
        times.append(time.monotonic() - began)
        began = time.monotonic()

    m = B.GradientBoosting(rounds=12, max_depth=1, min_data=5).fit(df, ["x", "z"], "y", "id", callbacks=[note])
    assert len(m.trees) == 12
    assert min(times[8:]) < 2 * sorted(times[2:6])[1] + 1  # a round does not get slower
    whole = m.score(df).agg(F.avg((F.col("raw0") - F.col("y")) ** 2)).first()[0]
    part = df.select("y", m.raw(best=2)[0].alias("raw0")).agg(F.avg((F.col("raw0") - F.col("y")) ** 2)).first()[0]
    assert whole < part


def test_streaming_fits_go_on_after_a_restart(spark, tmp_path):
    from larkspur import streaming as S
    from larkspur.operators.folds import OnlineKMeans, PassiveAggressive, SGDClassifier, SGDRegressor

    rows = [(i % 3, i, (i * 7 % 11) / 11, float(i * 5 % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, x double, y double")
    for learner, target in ((SGDRegressor(), "y"), (SGDClassifier([0, 1, 2]), "y"), (PassiveAggressive(), "y"), (PassiveAggressive(classes=[0, 1, 2]), "y"), (OnlineKMeans([[0.0], [1.0]]), None)):
        folder = str(tmp_path / type(learner).__name__ / str(getattr(learner, "classes", "")))
        make = lambda: S.StreamingFold(learner, ["x"], target, "k", "o", folder)  # noqa: B023, E731
        one, two = make(), make()
        one.update(df.where("o < 100"), 0)
        one.update(df.where("o >= 100 and o < 200"), 1)
        two.update(df.where("o >= 100 and o < 200"), 1)  # run again after a failure
        two.update(df.where("o >= 200"), 2)
        got = {r["k"]: (r["seen"], list(r["state"])) for r in two.result(spark).collect()}
        for k in range(3):
            state = learner.init(1)
            for kk, _, x, y in rows:
                if kk == k:
                    learner.learn(state, [x], y)
            assert got[k][0] == 100 and got[k][1] == pytest.approx(learner.pack(state))
    lin = S.StreamingLinearRegression(["x"], "y", str(tmp_path / "lin"))
    lin.update(df.where("o < 100"), 0)
    again = S.StreamingLinearRegression(["x"], "y", str(tmp_path / "lin"))
    again.update(df.where("o >= 100"), 1)
    again.update(df.where("o >= 100"), 1)
    whole = LinearRegression().fit(df, ["x"], "y")
    assert again.rows == 300 and again.model().coefficients == pytest.approx(whole.coefficients)


def test_adwin_needs_five_rows():
    from larkspur.operators.folds import ADWIN

    s, a = [[], 0], ADWIN(delta=0.3)
    assert [a.update(s, v) for v in (0.0, 0.0, 1.0, 1.0)] == [False] * 4 and a.update(s, 1.0)


def test_boosting_facades_and_callbacks(spark, tmp_path):
    from larkspur.operators import training as R

    df = spark.range(120).select("id", (F.col("id") % 12).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("y", F.col("x") * 2 + F.col("z")).withColumn("c", F.when(F.col("x") < 4, "low").when(F.col("x") < 8, "mid").otherwise("top")).withColumn("two", F.col("x") >= 6)
    seen, rates, saved = {}, [], []
    small = {"max_depth": 2, "min_data": 3, "NumIterations": 3, "eta": 0.5, "n_jobs": 4}
    m = R.train(small, df, ["x", "z"], "y", "id", valid=df, callbacks=[R.record(seen), R.learning_rates([0.5, 0.1, 0.1]), lambda r: rates.append(r.params["learning_rate"]), R.checkpoint(lambda model, i: saved.append((i, len(model.trees))), 2, True)])
    assert len(m.trees) == 3 and len(seen["valid"]) == 3 and seen["valid"] == sorted(seen["valid"], reverse=True) and rates == [0.1, 0.1, 0.1] and saved == [(1, 2)]
    assert len(R.train(small, df, ["x", "z"], "y", "id", callbacks=[R.time_limit(0.0)]).trees) == 1
    r = R.BoostedRegressor(**small).fit(df, ["x", "z"], "y", "id")
    assert r.score(df, "y") > 0.6 and r.predict(df).columns == [*df.columns, "prediction"]
    for target in ("c", "two"):
        c = R.BoostedClassifier(**small).fit(df, ["x", "z"], target, "id")
        p = c.predict_proba(df).select([f"p{i}" for i in range(len(c.labels))]).collect()
        assert c.score(df, target) > 0.95 and all(sum(x) == pytest.approx(1) for x in p)
    with pytest.raises(ValueError):
        R.BoostedClassifier().fit(df.where("c = 'low'"), ["x"], "c", "id")
    out = R.cv(small, df, ["x", "z"], "y", "id", 2, seed=1)
    assert len(out["losses"]) == 2 and out["mean"] == pytest.approx(sum(out["losses"]) / 2)
    best, model = R.quick(df, ["x", "z"], "y", "id", [{"rounds": 1}, {"rounds": 3}], 2, max_depth=2, min_data=3, learning_rate=0.5)
    assert best["rounds"] == 3 and len(model.trees) == 3
    assert R.plateau([9, 1, 1, 1, 1, 1], 0.1) and not R.plateau([1, 1], 0.1) and R.rising([1, 2, 3, 4, 5]) and not R.rising([1, 2, 2, 4, 5])
    assert B.canonical({"numLeaves": 3, "MaxBin": 9, "verbosity": 1}) == {"num_leaves": 3, "max_bin": 9}
    from larkspur.operators.nodes import from_text, to_text

    for model in (m, B.GradientBoosting(**(B.canonical(small) | {"categorical": ["z"], "rounds": 1})).fit(df, ["x", "z"], "y", "id")):
        a, b = (sorted(round(x["raw0"], 9) for x in e.score(df).select("raw0").collect()) for e in (model, from_text(to_text(model))))
        assert a == b


def test_mini_batch_k_means(spark):
    import numpy as np

    from larkspur.operators.cluster import KMeans, MiniBatchKMeans

    r = np.random.Generator(np.random.PCG64(3))
    at = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.concatenate([r.normal(c, 0.5, (60, 2)) for c in at])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for init in ("k-means++", "random"):
        m = MiniBatchKMeans(3, batch_size=30, max_iter=6, n_init=2, patience=2, init=init).fit(df, "v", "id")
        if init == "k-means++":
            assert sorted(np.round(m.centres / 10).astype(int).tolist()) == sorted((at // 10).tolist()) and m.inertia < 150
        assert m.predict(df, "v").select("cluster").distinct().count() <= 3 and {"d0", "d1", "d2"} <= set(m.transform(df, "v").columns)
    start = KMeans(3, seed=1).start(df, "v", "id")
    p = MiniBatchKMeans(3).partial_fit(df.where("id % 2 = 0"), "v", "id").partial_fit(df.where("id % 2 = 1"), "v", "id")
    near = ((x[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert p.counts.sum() == 180 and np.abs(p.centres - np.array([x[near == i].mean(axis=0) for i in range(3)])).max() < 0.5


def test_tree_by_bins(spark):
    from larkspur.operators.tree import DecisionTreeClassifier

    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.xxhash64("id") % 1000).cast("double").alias("b"))
    df = df.withColumn("y", ((F.col("a") > 3) & (F.col("b") > 100)).cast("int"))
    fit = lambda n: DecisionTreeClassifier(max_depth=2, max_bin=n).fit(df, ["a", "b"], "y")
    shape = lambda m: [(n.feature, round(n.threshold), n.left) for n in m.tree.nodes if not n.leaf]
    assert [n[0] for n in shape(fit(64))] == [n[0] for n in shape(fit(None))]
    hit = fit(64).predict(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.97
    small = df.where("b >= 0 and b < 20")  # few values: the bins are the values
    exact, binned = (DecisionTreeClassifier(max_depth=2, max_bin=n).fit(small, ["a", "b"], "y") for n in (None, 255))
    assert [(n.feature, n.threshold, n.count) for n in exact.tree.nodes] == [(n.feature, n.threshold, n.count) for n in binned.tree.nodes]
