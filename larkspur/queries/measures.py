"""Metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import ORACLES, query, rnd, rounded, Tables

# Prices against a fixed linear rule; some targets are made zero for the percentage error.
_RP = "(SELECT l_extendedprice AS y, 1000 * l_quantity + 5000 * l_discount - 2000 * l_tax AS p FROM lineitem)"


def _pairs(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (1000 * F.col("l_quantity") + 5000 * F.col("l_discount") - 2000 * F.col("l_tax")).alias("p"))


_REG = {
    "mse": "round(avg((y - p) * (y - p)), 2)",
    "rmse": "round(sqrt(avg((y - p) * (y - p))), 4)",
    "mae": "round(avg(abs(y - p)), 4)",
    "r2": "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 8)",
    "mape": "round(100 * avg(abs(y - p) / abs(y)) FILTER (WHERE y <> 0), 6)",
    "explained_variance": "round(1 - var_pop(y - p) / var_pop(y), 8)",
}
_DIGITS = {"mse": 2, "rmse": 4, "mae": 4, "r2": 8, "mape": 6, "explained_variance": 8}

for _name in _REG:

    @query(f"metric_{_name}", f"SELECT {_REG[_name]} + 0.0e0 AS {_name} FROM {_RP}")
    def _one(spark, sf_dir, name=_name):
        return M.regression(_pairs(Tables(spark, sf_dir)), name).select(rnd(name, _DIGITS[name]).alias(name))


@query("regression_report", "SELECT " + ", ".join(f"{v} + 0.0e0 AS {k}" for k, v in _REG.items()) + f" FROM {_RP}")
def regression_report(spark, sf_dir):
    return M.regression(_pairs(Tables(spark, sf_dir))).select(*[rnd(k, d).alias(k) for k, d in _DIGITS.items()])


# Labels against a rule on lengths.
_CP = "(SELECT quality AS y, CAST(n_chars > 400 AS INT) AS p FROM documents JOIN labels USING (doc_id))"
_SP = "(SELECT CAST(event_type = 'purchase' AS DOUBLE) AS y, round(value, 0) AS score FROM events)"


def _classes(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("p"))


def _events(t):
    return t.events.select((F.col("event_type") == "purchase").cast("double").alias("y"), F.round("value", 0).alias("score"))


@query("metric_accuracy", f"SELECT round(avg(CAST(y = p AS DOUBLE)), 8) + 0.0e0 AS accuracy FROM {_CP}")
def metric_accuracy(spark, sf_dir):
    return _classes(Tables(spark, sf_dir)).agg(rnd(M.accuracy_columns()["accuracy"], 8).alias("accuracy"))


@query("metric_error_rate", f"SELECT round(1 - avg(CAST(y = p AS DOUBLE)), 8) + 0.0e0 AS error_rate FROM {_CP}")
def metric_error_rate(spark, sf_dir):
    return _classes(Tables(spark, sf_dir)).agg(rnd(M.accuracy_columns()["error_rate"], 8).alias("error_rate"))


@query("metric_logloss", f"SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 8) + 0.0e0 AS logloss FROM (SELECT y, least(greatest(1 / (1 + exp(-score / 100)), 1e-15), 1 - 1e-15) AS q FROM {_SP})")
def metric_logloss(spark, sf_dir):
    x = M.check_binary(_events(Tables(spark, sf_dir))).withColumn("p", 1 / (1 + F.exp(-F.col("score") / 100)))
    return x.agg(rnd(M.log_loss(), 8).alias("logloss"))


_REPORT = f"SELECT c AS class, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, support FROM (SELECT c, CAST(count(*) FILTER (WHERE y = c) AS BIGINT) AS support, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS said, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS hit FROM {_CP} x, (SELECT DISTINCT y AS c FROM {_CP} UNION SELECT DISTINCT p FROM {_CP}) GROUP BY c)"


@query("class_report", f"SELECT class, round(precision, 8) + 0.0e0 AS precision, round(recall, 8) + 0.0e0 AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 8) + 0.0e0 AS f1, support FROM ({_REPORT})")
def class_report(spark, sf_dir):
    return rounded(M.class_report(_classes(Tables(spark, sf_dir))), 8)


@query("macro_prf", "SELECT round(p, 8) + 0.0e0 AS precision, round(r, 8) + 0.0e0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 8) + 0.0e0 AS f1 FROM (SELECT avg(precision) AS p, avg(recall) AS r FROM (SELECT c, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM (SELECT c, CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS support, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS said, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS hit FROM (SELECT event_id % 5 AS y, user_id % 5 AS p FROM events), (SELECT unnest(range(5)) AS c) GROUP BY c)))")
def macro_prf(spark, sf_dir):
    x = Tables(spark, sf_dir).events.select((F.col("event_id") % 5).alias("y"), (F.col("user_id") % 5).alias("p"))
    return rounded(M.prf(x), 8)


@query("confusion_matrix", f"SELECT y, p, count(*) AS n FROM {_CP} GROUP BY y, p")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_classes(Tables(spark, sf_dir)))


@query("class_union", f"SELECT y AS class FROM {_CP} UNION SELECT p FROM {_CP}")
def class_union(spark, sf_dir):
    return M.class_union(_classes(Tables(spark, sf_dir)))


@query("metric_auc", f"SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) + 0.0e0 AS auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS r FROM {_SP})")
def metric_auc(spark, sf_dir):
    return rounded(M.auc(_events(Tables(spark, sf_dir))), 8)


_TYPE = "CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"
_RANK = f"(SELECT user_id, {_TYPE} AS rel, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY {_TYPE} DESC, event_id) AS b FROM events)"


def _ranking(t):
    rel = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return t.events.select(F.col("user_id").alias("query"), rel.alias("rel"), F.col("value").alias("score"), F.col("event_id").alias("key"))


def _ndcg_sql(k: str) -> str:
    return f"SELECT user_id AS query, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 8) + 0.0e0 AS ndcg FROM (SELECT user_id, coalesce(sum((2.0e0 ** rel - 1) / log2(a + 1)) FILTER (WHERE a <= {k}), 0) AS d, coalesce(sum((2.0e0 ** rel - 1) / log2(b + 1)) FILTER (WHERE b <= {k}), 0) AS i FROM {_RANK} GROUP BY user_id)"


@query("metric_ndcg", _ndcg_sql("1000000000"))
def metric_ndcg(spark, sf_dir):
    return rounded(M.ndcg(_ranking(Tables(spark, sf_dir))), 8)


@query("metric_ndcg_at_k", _ndcg_sql("5"))
def metric_ndcg_at_k(spark, sf_dir):
    return rounded(M.ndcg(_ranking(Tables(spark, sf_dir)), k=5), 8)


_AP = f"SELECT user_id AS query, coalesce(sum(h * hits / a) / nullif(sum(h), 0), 0) AS ap FROM (SELECT user_id, a, CAST(rel > 0 AS DOUBLE) AS h, sum(CAST(rel > 0 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY a) AS hits FROM {_RANK}) GROUP BY user_id"


@query("metric_average_precision", f"SELECT query, round(ap, 8) + 0.0e0 AS ap FROM ({_AP})")
def metric_average_precision(spark, sf_dir):
    return rounded(M.average_precision(_ranking(Tables(spark, sf_dir))), 8)


@query("metric_map", f"SELECT round(avg(ap), 8) + 0.0e0 AS map FROM ({_AP})")
def metric_map(spark, sf_dir):
    return M.average_precision(_ranking(Tables(spark, sf_dir))).agg(rnd(F.avg("ap"), 8).alias("map"))


# Matrix forms: columns of arrays.


def _as_matrix(df, *columns):
    return df.withColumns({c: F.array(F.col(c).cast("double")) for c in columns})


@query("metric_auc_matrix", ORACLES["metric_auc"])
def metric_auc_matrix(spark, sf_dir):
    return rounded(M.auc(M.first_column(_as_matrix(_events(Tables(spark, sf_dir)), "y", "score"), "y", "score")), 8)


@query("metric_ndcg_matrix", ORACLES["metric_ndcg"])
def metric_ndcg_matrix(spark, sf_dir):
    return rounded(M.ndcg(M.first_column(_as_matrix(_ranking(Tables(spark, sf_dir)), "rel", "score"), "rel", "score")), 8)


@query("metric_mse_matrix", "SELECT round(avg((l_quantity - 25) ** 2), 6) + 0.0e0 AS mse FROM lineitem")
def metric_mse_matrix(spark, sf_dir):
    x = _as_matrix(Tables(spark, sf_dir).lineitem.select(F.col("l_quantity").alias("y"), F.lit(25.0).alias("p")), "y", "p")
    return rounded(M.regression(M.first_column(x, "y", "p", only=True), "mse"))


@query("metric_multi_logloss", "SELECT round(avg(-ln(greatest(least(CASE event_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE 0.5e0 END / (a + b + 0.5e0), 1 - 1e-15), 1e-15))), 8) + 0.0e0 AS loss FROM (SELECT event_id, (event_id % 11) / 11.0e0 AS a, (event_id % 7 + 1) / 8.0e0 AS b FROM events)")
def metric_multi_logloss(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select((F.col("event_id") % 3).alias("y"), ((F.col("event_id") % 11) / F.lit(11.0)).alias("a"), ((F.col("event_id") % 7 + 1) / F.lit(8.0)).alias("b"), F.lit(0.5).alias("c"))
    return rounded(e.agg(M.multiclass_log_loss("y", ["a", "b", "c"]).alias("loss")), 8)
