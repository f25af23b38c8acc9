"""Scans, scalers, encoders, guards, folds and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frame import guard_counts, num, shared_dir
from ..functions import numeric as N
from ..operators import selection
from ..operators.preprocessing import MinMaxScaler, OneHotEncoder, StandardScaler, task_type
from ..sources import chunks, csv, rows_between, table, write_chunks
from .registry import Tables, frame, query, rnd, rounded

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, cols=COLS) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in cols)


def _scaled(df, model):
    """One row for each feature: what was fitted and the extent of the scaled values."""
    x = model.transform(df.select(*model.features))
    parts = [F.struct(F.lit(c).alias("feature"), rnd(F.lit(m)).alias("shift"), rnd(F.lit(s)).alias("scale"), rnd(F.min(c)).alias("low"), rnd(F.max(c)).alias("high"), rnd(F.avg(F.col(c) * F.col(c)), 5).alias("mean_square")) for c, m, s in zip(model.features, model.shift, model.scale, strict=True)]
    return x.agg(F.array(*parts).alias("x")).select(F.inline("x"))


_SCALED = "SELECT '{c}' AS feature, round(m, 6) + 0.0e0 AS shift, round(s, 6) + 0.0e0 AS scale, round((lo - m) / s * {gain} + {base}, 6) + 0.0e0 AS low, round((hi - m) / s * {gain} + {base}, 6) + 0.0e0 AS high, round(ms, 5) + 0.0e0 AS mean_square FROM (SELECT {m} AS m, {s} AS s, min({c}) AS lo, max({c}) AS hi, avg((({c} - (SELECT {m} FROM lineitem)) / (SELECT {s} FROM lineitem) * {gain} + {base}) ** 2) AS ms FROM lineitem)"


def _sql(m: str, s: str, gain: str = "1.0e0", base: str = "0.0e0") -> str:
    return " UNION ALL ".join(_SCALED.format(c=c, m=m.format(c=c), s=s.format(c=c), gain=gain, base=base) for c in COLS)


@query("scan_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) + 0.0e0 AS net FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def scan_filter_project(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'")
    return x.select("l_orderkey", "l_linenumber", rnd(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("chunk_stats", "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS chunk, count(*) AS n, round(avg(o_totalprice), 4) + 0.0e0 AS mean, min(o_orderkey) AS first FROM orders GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return chunks(Tables(spark, sf_dir).orders, "o_orderkey", 1000).groupBy("chunk").agg(F.count("*").alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderkey").alias("first"))


@query("standard_scaler", _sql("avg({c})", "stddev_pop({c})"))
def standard_scaler(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return _scaled(df, StandardScaler().fit(df, COLS))


@query("standard_scaler_no_mean", _sql("any_value(0.0e0)", "sqrt(avg({c} * {c}))"))
def standard_scaler_no_mean(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return _scaled(df, StandardScaler(with_mean=False).fit(df, COLS))


@query("standard_scaler_no_std", _sql("avg({c})", "any_value(1.0e0)"))
def standard_scaler_no_std(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return rounded(_scaled(df, StandardScaler(with_std=False).fit(df, COLS)), 3)


@query("minmax_scaler", _sql("min({c})", "max({c}) - min({c})"))
def minmax_scaler(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return _scaled(df, MinMaxScaler().fit(df, COLS))


@query("minmax_scaler_range", _sql("min({c})", "max({c}) - min({c})", "3.0e0", "-1.0e0"))
def minmax_scaler_range(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return _scaled(df, MinMaxScaler(-1.0, 2.0).fit(df, COLS))


from .registry import ORACLES  # noqa: E402

ORACLES["standard_scaler_no_std"] = f"SELECT feature, round(shift, 3) + 0.0e0 AS shift, round(scale, 3) + 0.0e0 AS scale, round(low, 3) + 0.0e0 AS low, round(high, 3) + 0.0e0 AS high, round(mean_square, 3) + 0.0e0 AS mean_square FROM ({ORACLES['standard_scaler_no_std']})"
_BACK = "SELECT count(*) AS n, round(sum(l_quantity), 3) + 0.0e0 AS l_quantity, round(sum(l_extendedprice), 2) + 0.0e0 AS l_extendedprice FROM lineitem"


def _back(spark, sf_dir, estimator):
    df = Tables(spark, sf_dir).lineitem
    m = estimator.fit(df, COLS[:2])
    x = m.inverse_transform(m.transform(df))
    return x.agg(F.count("*").alias("n"), rnd(F.sum("l_quantity"), 3).alias("l_quantity"), rnd(F.sum("l_extendedprice"), 2).alias("l_extendedprice"))


@query("standard_scaler_inverse", _BACK)
def standard_scaler_inverse(spark, sf_dir):
    return _back(spark, sf_dir, StandardScaler())


@query("minmax_inverse", _BACK)
def minmax_inverse(spark, sf_dir):
    return _back(spark, sf_dir, MinMaxScaler(-2.0, 5.0))


CATS = ["l_returnflag", "l_linestatus"]


@query("onehot_categories", "SELECT feature, category FROM (SELECT DISTINCT 'l_returnflag' AS feature, l_returnflag AS category FROM lineitem UNION SELECT 'l_linestatus', l_linestatus FROM lineitem)")
def onehot_categories(spark, sf_dir):
    return OneHotEncoder().categories(Tables(spark, sf_dir).lineitem, CATS).select("feature", "category")


@query("onehot_encode", "SELECT l_returnflag, l_linestatus, CAST(l_returnflag = 'A' AS DOUBLE) AS rf_A, CAST(l_returnflag = 'N' AS DOUBLE) AS rf_N, CAST(l_returnflag = 'R' AS DOUBLE) AS rf_R, CAST(l_linestatus = 'F' AS DOUBLE) AS ls_F, CAST(l_linestatus = 'O' AS DOUBLE) AS ls_O, count(*) AS n FROM lineitem GROUP BY ALL")
def onehot_encode(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    x = OneHotEncoder().fit(df, CATS).transform(df, ["rf", "ls"])
    return x.groupBy(*CATS, *[c for c in x.columns if c[:3] in ("rf_", "ls_")]).agg(F.count("*").alias("n"))


@query("onehot_unknown", "SELECT l_returnflag, CAST(l_returnflag = 'A' AS DOUBLE) AS rf_A, CAST(l_returnflag = 'N' AS DOUBLE) AS rf_N, count(*) AS n FROM lineitem GROUP BY ALL")
def onehot_unknown(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    x = OneHotEncoder().fit(df.where("l_returnflag <> 'R'"), CATS[:1]).transform(df, ["rf"])
    return x.groupBy("l_returnflag", "rf_A", "rf_N").agg(F.count("*").alias("n"))


@query("onehot_names", "SELECT 'x0_' || c AS name FROM (SELECT DISTINCT l_returnflag AS c FROM lineitem) UNION ALL SELECT 'x1_' || c FROM (SELECT DISTINCT l_linestatus AS c FROM lineitem)")
def onehot_names(spark, sf_dir):
    return frame(spark, [(n,) for n in OneHotEncoder().fit(Tables(spark, sf_dir).lineitem, CATS).names()], "name string")


@query("numeric_guard", _union("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE v IS NULL) AS n_null, count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE isinf(v)) AS n_inf FROM (SELECT CAST({c} AS DOUBLE) / CASE WHEN {c} = 0 THEN NULL ELSE 1 END AS v FROM lineitem)"))
def numeric_guard(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem.select(*[F.when(F.col(c) != 0, F.col(c)).alias(c) for c in COLS])
    return guard_counts(df, COLS)


@query("task_type_detect", "SELECT name, CASE WHEN whole AND k < 20 AND k <= n / 4 THEN 'classification' ELSE 'regression' END AS task FROM (SELECT 'l_linenumber' AS name, bool_and(l_linenumber = floor(l_linenumber)) AS whole, count(DISTINCT l_linenumber) AS k, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', bool_and(l_quantity = floor(l_quantity)), count(DISTINCT l_quantity), count(*) FROM lineitem UNION ALL SELECT 'l_discount', bool_and(l_discount = floor(l_discount)), count(DISTINCT l_discount), count(*) FROM lineitem)")
def task_type_detect(spark, sf_dir):
    df = Tables(spark, sf_dir).lineitem
    return frame(spark, [(c, task_type(df, c)) for c in ("l_linenumber", "l_quantity", "l_discount")], "name string, task string")


@query("kfold_assign", "SELECT fold, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders) GROUP BY fold")
def kfold_assign(spark, sf_dir):
    return selection.kfold(Tables(spark, sf_dir).orders, "o_orderkey", 7).groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("stratified_kfold", "SELECT o_orderstatus, fold, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, o_orderstatus, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders) GROUP BY ALL")
def stratified_kfold(spark, sf_dir):
    return selection.stratified_kfold(Tables(spark, sf_dir).orders, "o_orderkey", "o_orderstatus", 5).groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("bagging_sample", "SELECT CAST(floor(count(*) * 0.6e0) AS BIGINT) AS n, CAST(floor(count(*) * 0.6e0) AS BIGINT) AS distinct_keys, true AS same_twice FROM orders")
def bagging_sample(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    a, b = selection.bagging(o, "o_orderkey", 0.6, 3), selection.bagging(o.repartition(5), "o_orderkey", 0.6, 3)
    left = a.join(b, "o_orderkey", "left_anti").count()
    return a.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"), F.lit(left == 0).alias("same_twice"))


@query("goss_sample", "SELECT amplify, CAST(n AS BIGINT) AS n, CASE WHEN amplify = 1 THEN (SELECT round(min(g), 4) FROM (SELECT abs(o_totalprice - 150000) AS g FROM orders ORDER BY g DESC, o_orderkey LIMIT (SELECT CAST(floor(count(*) * 0.2e0) AS BIGINT) FROM orders))) END AS least FROM (SELECT 1.0e0 AS amplify, floor(count(*) * 0.2e0) AS n FROM orders UNION ALL SELECT round(0.8e0 / 0.1e0, 6), floor((count(*) - floor(count(*) * 0.2e0)) * 0.1e0) FROM orders)")
def goss_sample(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_totalprice") - 150000).alias("g"))
    s = selection.goss(o, "o_orderkey", "g", 0.2, 0.1, 5).withColumn("amplify", rnd("amplify"))
    return s.groupBy("amplify").agg(F.count("*").alias("n"), F.when(F.first("amplify") == 1, rnd(F.min(F.abs("g")), 4)).alias("least"))


_V = "(l_extendedprice - 30000) / 10000"


@query("sigmoid", f"SELECT l_linestatus, round(avg(1 / (1 + exp(-({_V})))), 8) + 0.0e0 AS p, round(avg(exp({_V} / 10)), 8) + 0.0e0 AS e FROM lineitem GROUP BY 1")
def sigmoid(spark, sf_dir):
    v = (num("l_extendedprice") - 30000) / 10000
    return Tables(spark, sf_dir).lineitem.groupBy("l_linestatus").agg(rnd(F.avg(N.sigmoid(v)), 8).alias("p"), rnd(F.avg(N.exp_link(v / 10)), 8).alias("e"))


@query("exp_link", "SELECT l_linestatus, round(avg(exp(l_discount * l_quantity)), 6) + 0.0e0 AS e, round(max(ln(exp(l_tax) + exp(l_discount))), 8) + 0.0e0 AS lse FROM lineitem GROUP BY 1")
def exp_link(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.groupBy("l_linestatus").agg(rnd(F.avg(N.exp_link(F.col("l_discount") * F.col("l_quantity")))).alias("e"), rnd(F.max(N.log_sum_exp([F.col("l_tax"), F.col("l_discount")])), 8).alias("lse"))


@query("softmax", "SELECT l_linestatus, round(avg(exp(a) / (exp(a) + exp(b) + exp(c))), 8) + 0.0e0 AS p0, round(avg(exp(b) / (exp(a) + exp(b) + exp(c))), 8) + 0.0e0 AS p1, CAST(sum(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END) AS BIGINT) AS argmax FROM (SELECT l_linestatus, l_tax * 10 AS a, l_discount * 10 AS b, l_quantity / 100 AS c FROM lineitem) GROUP BY 1")
def softmax(spark, sf_dir):
    xs = [F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") / 100]
    p = N.softmax(xs)
    return Tables(spark, sf_dir).lineitem.groupBy("l_linestatus").agg(rnd(F.avg(p[0]), 8).alias("p0"), rnd(F.avg(p[1]), 8).alias("p1"), F.sum(N.argmax(xs)).alias("argmax"))


@query("numeric_helpers", "SELECT round(avg(CASE WHEN l_discount < 1e-10 THEN 0 ELSE l_tax / l_discount END), 8) + 0.0e0 AS safe, round(avg(least(greatest(l_quantity, 5), 40)), 8) + 0.0e0 AS clipped, round(avg(l_quantity * CASE WHEN sqrt(l_quantity ** 2 + l_tax ** 2) > 10 THEN 10 / sqrt(l_quantity ** 2 + l_tax ** 2) ELSE 1 END), 8) + 0.0e0 AS g, round(avg(ln(greatest(l_discount, 1e-15))), 8) + 0.0e0 AS log FROM lineitem")
def numeric_helpers(spark, sf_dir):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return Tables(spark, sf_dir).lineitem.agg(rnd(F.avg(N.safe_divide(t, d)), 8).alias("safe"), rnd(F.avg(N.clip(q, 5, 40)), 8).alias("clipped"), rnd(F.avg(N.clip_norm([q, t], 10)[0]), 8).alias("g"), rnd(F.avg(N.safe_log(d)), 8).alias("log"))


@query("csv_scan", "SELECT r_regionkey, r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY ALL")
def csv_scan(spark, sf_dir):
    """Tables written as CSV and read with a schema."""
    t, base = Tables(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    t.region.select("r_regionkey", "r_name").write.csv(f"{base}/region", header=True)
    t.nation.select("n_nationkey", "n_regionkey").write.csv(f"{base}/nation", header=True)
    region, nation = csv(spark, f"{base}/region", "r_regionkey long, r_name string"), csv(spark, f"{base}/nation", "n_nationkey long, n_regionkey long")
    r = region.where("r_name <> 'ASIA'").join(F.broadcast(nation), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    return r.groupBy(F.col("r_regionkey").cast(t.region.schema["r_regionkey"].dataType).alias("r_regionkey"), "r_name").agg(F.count("*").alias("nations"))


@query("chunk_replace", "SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS chunk, count(*) AS n, round(sum(CASE WHEN floor(o_orderkey / 1000) = 1 THEN 2 * o_totalprice ELSE o_totalprice END), 2) + 0.0e0 AS total FROM orders GROUP BY 1")
def chunk_replace(spark, sf_dir):
    """One chunk of a written table put in the place of the old one."""
    o, path = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice"), f"{shared_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    write_chunks(o, "o_orderkey", 1000, path)
    write_chunks(rows_between(o, "o_orderkey", 1000, 2000).withColumn("o_totalprice", 2 * F.col("o_totalprice")), "o_orderkey", 1000, path, replace=True)
    return spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))
