"""Ordered folds by user: SGD, passive-aggressive, drift detectors, test-then-train. The SQL steps through ranks recursively."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.folds import ADWIN, DDM, OnlineKMeans, PassiveAggressive, SGDClassifier, SGDRegressor
from .registry import Tables, query, rounded

# x and y of each event; rn numbers a user's events.
def _rows_sql(order: str = "event_id") -> str:
    return f"rows AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn, (event_id % 7) / 7.0e0 AS x, (event_id % 3) / 3.0e0 AS z, value / 100 AS y, CAST(event_type = 'purchase' OR event_type = 'click' AS INT) AS c FROM events)"


_ROWS = _rows_sql()


def _events(t):
    e = t.events
    return e.select("user_id", "event_id", ((F.col("event_id") % 7) / F.lit(7.0)).alias("x"), ((F.col("event_id") % 3) / F.lit(3.0)).alias("z"), (F.col("value") / 100).alias("y"), F.col("event_type").isin("purchase", "click").cast("int").alias("c"), (F.col("event_type") != "error").alias("ok"))


_SLOPE = {"squared_error": "p - y", "huber": "CASE WHEN abs(p - y) <= 0.1e0 THEN p - y ELSE sign(p - y) * 0.1e0 END", "epsilon_insensitive": "CASE WHEN abs(p - y) <= 0.1e0 THEN 0e0 ELSE sign(p - y) END"}


def _sgd_sql(loss: str, select: str, order: str = "event_id") -> str:
    g = "(s * x + 1e-4 * w0)", "(s * z + 1e-4 * w1)"
    norm = f"sqrt({g[0]} ** 2 + {g[1]} ** 2)"
    scale = f"CASE WHEN {norm} > 10 THEN 10 / {norm} ELSE 1 END"
    eta = "(0.05e0 / (rn ** 0.25e0))"
    return f"""WITH RECURSIVE {_rows_sql(order)}, f(user_id, rn, b, w0, w1, p) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0.0e0, 0.0e0, 0.0e0, NULL::DOUBLE FROM rows
  UNION ALL
  SELECT user_id, rn, b - {eta} * s, w0 - {eta} * {scale} * {g[0]}, w1 - {eta} * {scale} * {g[1]}, CASE WHEN rn > 1 THEN p END
  FROM (SELECT *, {_SLOPE[loss]} AS s FROM (SELECT f.user_id, r.rn, b, w0, w1, x, z, y, b + w0 * x + w1 * z AS p FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))
{select}"""


_LAST = "SELECT user_id, rn AS n, round(b, 7) + 0.0e0 AS intercept, round(w0, 7) + 0.0e0 AS w0, round(w1, 7) + 0.0e0 AS w1 FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)"

for _short, _loss in (("squared", "squared_error"), ("huber", "huber"), ("epsilon", "epsilon_insensitive")):

    @query(f"sgdr_fold_{_short}", _sgd_sql(_loss, _LAST))
    def _sgdr(spark, sf_dir, loss=_loss):
        return rounded(SGDRegressor(loss, eta0=0.05).fit_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", ["x", "z"], "y"), 7)


@query("prequential_error", _sgd_sql("squared_error", "SELECT f.user_id, count(f.p) AS n, round(avg((f.p - r.y) ** 2), 7) + 0.0e0 AS mse FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn WHERE f.p IS NOT NULL GROUP BY f.user_id"))
def prequential_error(spark, sf_dir):
    e = _events(Tables(spark, sf_dir))
    p = SGDRegressor("squared_error", eta0=0.05).prequential(e, "user_id", "event_id", ["x", "z"], "y").where("prediction is not null")
    x = p.join(e.select("event_id", "y"), "event_id")
    return rounded(x.groupBy("user_id").agg(F.count("prediction").alias("n"), F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")), 7)


_MARGIN = {"hinge": "CASE WHEN m < 1 THEN -1e0 ELSE 0e0 END", "squared_hinge": "CASE WHEN m < 1 THEN -2 * (1 - m) ELSE 0e0 END", "perceptron": "CASE WHEN m <= 0 THEN -1e0 ELSE 0e0 END", "log": "-1 / (1 + exp(least(m, 700)))", "modified_huber": "CASE WHEN m >= 1 THEN 0e0 WHEN m >= -1 THEN -2 * (1 - m) ELSE -4e0 END"}


def _sgdc_sql(loss: str, order: str = "event_id") -> str:
    """Both one-vs-all parts; the first is the mirror of the second only for symmetric starts, so both are carried."""
    eta = "(0.05e0 / (rn ** 0.25e0))"
    part = lambda k: f"b{k} - {eta} * s{k}, u{k} - {eta} * (s{k} * x + 1e-4 * u{k}), v{k} - {eta} * (s{k} * z + 1e-4 * v{k})"
    return f"""WITH RECURSIVE {_rows_sql(order)}, f(user_id, rn, b0, u0, v0, b1, u1, v1) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0 FROM rows
  UNION ALL
  SELECT user_id, rn, {part(0)}, {part(1)}
  FROM (SELECT *, g0 * ({_MARGIN[loss].replace('m ', 'm0 ').replace('(m,', '(m0,').replace('- m)', '- m0)')}) AS s0, g1 * ({_MARGIN[loss].replace('m ', 'm1 ').replace('(m,', '(m1,').replace('- m)', '- m1)')}) AS s1
    FROM (SELECT *, g0 * (b0 + u0 * x + v0 * z) AS m0, g1 * (b1 + u1 * x + v1 * z) AS m1
      FROM (SELECT f.user_id, r.rn, b0, u0, v0, b1, u1, v1, x, z, CASE WHEN c = 0 THEN 1e0 ELSE -1e0 END AS g0, CASE WHEN c = 1 THEN 1e0 ELSE -1e0 END AS g1
        FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1))))
SELECT user_id, rn AS n, round(b0, 7) + 0.0e0 AS b0, round(u0, 7) + 0.0e0 AS w0_0, round(v0, 7) + 0.0e0 AS w0_1, round(b1, 7) + 0.0e0 AS b1, round(u1, 7) + 0.0e0 AS w1_0, round(v1, 7) + 0.0e0 AS w1_1
FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)"""


for _loss in _MARGIN:

    @query(f"sgdc_fold_{_loss}", _sgdc_sql(_loss))
    def _sgdc(spark, sf_dir, loss=_loss):
        learner = SGDClassifier([0, 1], "log_loss" if loss == "log" else loss, eta0=0.05)
        return rounded(learner.fit_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", ["x", "z"], "c"), 7)


@query("par_fold", f"""WITH RECURSIVE {_ROWS}, f(user_id, rn, b, w0, w1) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0.0e0, 0.0e0, 0.0e0 FROM rows
  UNION ALL
  SELECT user_id, rn, b + tau, w0 + tau * x, w1 + tau * z
  FROM (SELECT *, CASE WHEN y >= p THEN 1e0 ELSE -1e0 END * greatest(0e0, abs(y - p) - 0.1e0) / (x * x + z * z + 0.5e0) AS tau
    FROM (SELECT f.user_id, r.rn, b, w0, w1, x, z, y, b + w0 * x + w1 * z AS p FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))
SELECT user_id, round(b, 7) + 0.0e0 AS b, round(w0, 7) + 0.0e0 AS w0, round(w1, 7) + 0.0e0 AS w1 FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)""")
def par_fold(spark, sf_dir):
    return rounded(PassiveAggressive().fit_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", ["x", "z"], "y"), 7)


def _pac_sql(order: str = "event_id") -> str:
    return f"""WITH RECURSIVE {_rows_sql(order)}, f(user_id, rn, b0, u0, v0, b1, u1, v1) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0 FROM rows
  UNION ALL
  SELECT user_id, rn, b0 + t0, u0 + t0 * x, v0 + t0 * z, b1 + t1, u1 + t1 * x, v1 + t1 * z
  FROM (SELECT *, g0 * greatest(0e0, 1 - g0 * (b0 + u0 * x + v0 * z)) / (x * x + z * z + 0.5e0) AS t0, g1 * greatest(0e0, 1 - g1 * (b1 + u1 * x + v1 * z)) / (x * x + z * z + 0.5e0) AS t1
    FROM (SELECT f.user_id, r.rn, b0, u0, v0, b1, u1, v1, x, z, CASE WHEN c = 0 THEN 1e0 ELSE -1e0 END AS g0, CASE WHEN c = 1 THEN 1e0 ELSE -1e0 END AS g1
      FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))
SELECT user_id, round(b0, 7) + 0.0e0 AS b0, round(u0, 7) + 0.0e0 AS w0_0, round(v0, 7) + 0.0e0 AS w0_1, round(b1, 7) + 0.0e0 AS b1, round(u1, 7) + 0.0e0 AS w1_0, round(v1, 7) + 0.0e0 AS w1_1
FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)"""


@query("pac_fold", _pac_sql())
def pac_fold(spark, sf_dir):
    return rounded(PassiveAggressive(classes=[0, 1]).fit_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", ["x", "z"], "c"), 7)


@query("ddm_fold", """WITH RECURSIVE rows AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(event_type = 'error' AS BIGINT) AS e FROM events),
f(user_id, rn, n, errors, pm, sm, warnings, drifts) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1e300, 1e300, 0::BIGINT, 0::BIGINT FROM rows
  UNION ALL
  SELECT user_id, rn, CASE WHEN drift THEN 0 ELSE n END, CASE WHEN drift THEN 0 ELSE errors END, CASE WHEN drift THEN 1e300 ELSE qm END, CASE WHEN drift THEN 1e300 ELSE tm END,
    warnings + CAST(NOT drift AND n >= 30 AND p + s > qm + 2 * tm AS BIGINT), drifts + CAST(drift AS BIGINT)
  FROM (SELECT *, n >= 30 AND p + s > qm + 3 * tm AS drift
    FROM (SELECT *, CASE WHEN n >= 30 AND p + s < pm + sm THEN p ELSE pm END AS qm, CASE WHEN n >= 30 AND p + s < pm + sm THEN s ELSE sm END AS tm
      FROM (SELECT *, sqrt(p * (1 - p) / n) AS s
        FROM (SELECT *, errors / CAST(n AS DOUBLE) AS p
          FROM (SELECT f.user_id, r.rn, f.n + 1 AS n, f.errors + r.e AS errors, pm, sm, warnings, drifts FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1))))))
SELECT user_id, n, warnings, drifts FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)""")
def ddm_fold(spark, sf_dir):
    return DDM().fold_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", "ok")


def _kmeans_sql(order: str = "event_id") -> str:
    """Two centres from (0, 0) and (1, 1); a tie goes to the first."""
    return f"""WITH RECURSIVE {_rows_sql(order)}, f(user_id, rn, n0, n1, a0, a1, b0, b1) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 1.0e0, 1.0e0 FROM rows
  UNION ALL
  SELECT user_id, rn, n0 + u, n1 + 1 - u, CASE WHEN u = 1 THEN (1 - 1 / (n0 + 1)) * a0 + x / (n0 + 1) ELSE a0 END, CASE WHEN u = 1 THEN (1 - 1 / (n0 + 1)) * a1 + z / (n0 + 1) ELSE a1 END,
    CASE WHEN u = 0 THEN (1 - 1 / (n1 + 1)) * b0 + x / (n1 + 1) ELSE b0 END, CASE WHEN u = 0 THEN (1 - 1 / (n1 + 1)) * b1 + z / (n1 + 1) ELSE b1 END
  FROM (SELECT *, CASE WHEN (x - a0) ** 2 + (z - a1) ** 2 <= (x - b0) ** 2 + (z - b1) ** 2 THEN 1 ELSE 0 END AS u
    FROM (SELECT f.user_id, r.rn, n0, n1, a0, a1, b0, b1, x, z FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))
SELECT user_id, n0, n1, round(a0, 7) + 0.0e0 AS c0_0, round(a1, 7) + 0.0e0 AS c0_1, round(b0, 7) + 0.0e0 AS c1_0, round(b1, 7) + 0.0e0 AS c1_1 FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)"""


@query("kmeans_online", _kmeans_sql())
def kmeans_online(spark, sf_dir):
    return rounded(OnlineKMeans([[0.0, 0.0], [1.0, 1.0]]).fit_keys(_events(Tables(spark, sf_dir)), "user_id", "event_id", ["x", "z"]), 7)


@query("adwin_fold", """WITH RECURSIVE rows AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(event_type = 'error' AS DOUBLE) AS v FROM events),
f(user_id, rn, w, drifts) AS (
  SELECT DISTINCT user_id, 0::BIGINT, CAST([] AS STRUCT(n BIGINT, s DOUBLE)[]), 0::BIGINT FROM rows
  UNION ALL
  SELECT user_id, rn, CASE WHEN cut IS NULL THEN w ELSE w[cut + 1:] END, drifts + CAST(cut IS NOT NULL AS BIGINT)
  FROM (SELECT *, CASE WHEN n >= 5 THEN list_min(list_filter(range(1, len(w)), lambda i:
          abs(list_sum(list_transform(w[1:i], lambda b: b.s)) / list_sum(list_transform(w[1:i], lambda b: b.n)) - list_sum(list_transform(w[i + 1:], lambda b: b.s)) / list_sum(list_transform(w[i + 1:], lambda b: b.n)))
          > sqrt(0.5e0 * (1e0 / list_sum(list_transform(w[1:i], lambda b: b.n)) + 1e0 / list_sum(list_transform(w[i + 1:], lambda b: b.n))) * ln(2 / 0.3e0)))) END AS cut
    FROM (SELECT *, list_sum(list_transform(w, lambda b: b.n)) AS n
      FROM (SELECT user_id, rn, drifts, CASE WHEN len(w) > 200 THEN w[2:] ELSE w END AS w
        FROM (SELECT f.user_id, r.rn, f.drifts, CASE WHEN len(w) > 0 AND w[-1].n = 1 THEN list_append(w[1:len(w) - 1], {'n': 2::BIGINT, 's': w[-1].s + r.v}) ELSE list_append(w, {'n': 1::BIGINT, 's': r.v}) END AS w
          FROM f JOIN rows r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))))
SELECT user_id, drifts, CAST(list_sum(list_transform(w, lambda b: b.n)) AS BIGINT) AS width, round(list_sum(list_transform(w, lambda b: b.s)) / list_sum(list_transform(w, lambda b: b.n)), 8) + 0.0e0 AS mean
FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM rows GROUP BY 1)""")
def adwin_fold(spark, sf_dir):
    e = _events(Tables(spark, sf_dir)).withColumn("error", (~F.col("ok")).cast("double"))
    return rounded(ADWIN(delta=0.3).fold_keys(e, "user_id", "event_id", "error"), 8)
