"""Least squares, logistic regression, naive Bayes, k-means, CART, pipelines, cross-validation, model files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frame import num, shared_dir, written
from ..operators import cluster, selection
from ..operators.linear import ClassifierModel, LinearModel, LinearRegression, LogisticRegression
from ..operators.naive_bayes import MultinomialNB, ascii_tokens, vocabulary
from ..operators.preprocessing import MinMaxScaler, StandardScaler
from ..operators.tree import DecisionTreeClassifier, best_splits, candidates
from ..plans.persist import load, save
from ..plans.pipeline import Pipeline
from .registry import Tables, frame, query, rnd, rounded


def _model(spark, m: LinearModel, digits: int = 6):
    rows = [("intercept", float(m.intercept)), *zip(m.features, map(float, m.coefficients), strict=True)]
    return rounded(frame(spark, rows, "name string, value double"), digits)


@query("linreg_simple", "SELECT 'intercept' AS name, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0e0 AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0e0 FROM lineitem")
def linreg_simple(spark, sf_dir):
    return _model(spark, LinearRegression().fit(Tables(spark, sf_dir).lineitem, ["l_quantity"], "l_extendedprice"), 4)


# Two features by Cramer's rule on centred moments.
_CENTRED = "SELECT avg(l_quantity) AS ma, avg(l_tax) AS mb, avg(l_extendedprice) AS my, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS \"by\" FROM lineitem"
_TWO = f'SELECT *, (ay * bb - "by" * ab) / (aa * bb - ab * ab) AS wa, ("by" * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM ({_CENTRED})'


@query("linreg_multi", f"SELECT 'intercept' AS name, round(my - wa * ma - wb * mb, 3) + 0.0e0 AS value FROM ({_TWO}) UNION ALL SELECT 'l_quantity', round(wa, 4) + 0.0e0 FROM ({_TWO}) UNION ALL SELECT 'l_tax', round(wb, 3) + 0.0e0 FROM ({_TWO})")
def linreg_multi(spark, sf_dir):
    m = LinearRegression().fit(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_tax"], "l_extendedprice")
    x = frame(spark, [("intercept", m.intercept, 3), ("l_quantity", m.coefficients[0], 4), ("l_tax", m.coefficients[1], 3)], "name string, value double, d int")
    return x.select("name", F.when(F.col("d") == 3, rnd("value", 3)).otherwise(rnd("value", 4)).alias("value"))


@query("linreg_no_intercept", "SELECT 'intercept' AS name, 0.0e0 AS value UNION ALL SELECT 'l_quantity', round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 5) + 0.0e0 FROM lineitem")
def linreg_no_intercept(spark, sf_dir):
    return _model(spark, LinearRegression(fit_intercept=False).fit(Tables(spark, sf_dir).lineitem, ["l_quantity"], "l_extendedprice"), 5)


_NEG = "SELECT 'intercept' AS name, round(avg(-l_extendedprice) - greatest(regr_slope(-l_extendedprice, l_quantity), 0) * avg(l_quantity), 3) + 0.0e0 AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(greatest(regr_slope(-l_extendedprice, l_quantity), 0), 3) + 0.0e0 FROM lineitem"


@query("linreg_positive", _NEG)
def linreg_positive(spark, sf_dir):
    x = Tables(spark, sf_dir).lineitem.select("l_quantity", (-F.col("l_extendedprice")).alias("y"))
    return _model(spark, LinearRegression(positive=True).fit(x, ["l_quantity"], "y"), 3)


@query("linreg_score", "SELECT round(regr_r2(l_extendedprice, l_quantity), 8) + 0.0e0 AS r2 FROM lineitem")
def linreg_score(spark, sf_dir):
    x = Tables(spark, sf_dir).lineitem
    m = LinearRegression().fit(x, ["l_quantity"], "l_extendedprice")
    return rounded(frame(spark, [(m.score(x, "l_extendedprice"),)], "r2 double"), 8)


@query("linreg_predict", "SELECT o_orderstatus, count(*) AS n, round(avg(1.5e0 + 0.25e0 * o_totalprice - 3.0e0 * (o_custkey % 10)), 4) + 0.0e0 AS mean FROM orders GROUP BY 1")
def linreg_predict(spark, sf_dir):
    x = Tables(spark, sf_dir).orders.select("o_orderstatus", "o_totalprice", (F.col("o_custkey") % 10).alias("k"))
    return LinearModel(("o_totalprice", "k"), (0.25, -3.0), 1.5).predict(x).groupBy("o_orderstatus").agg(F.count("*").alias("n"), rnd(F.avg("prediction"), 4).alias("mean"))


_JSON = '{"model_spec": {"name": "LinearRegression", "format_version": "1.0", "sklearn_version": "1.3.0"}, "params": {"coefficients": [2.0, 3.0, -1.0], "intercept": 5.0, "n_features": 3}}'


@query("linreg_json_import", "SELECT l_returnflag, round(avg(5 + 2 * l_quantity + 3 * l_discount - l_tax), 6) + 0.0e0 AS mean FROM lineitem GROUP BY 1")
def linreg_json_import(spark, sf_dir):
    m = LinearModel.from_json(_JSON, ["l_quantity", "l_discount", "l_tax"])
    return m.predict(Tables(spark, sf_dir).lineitem).groupBy("l_returnflag").agg(rnd(F.avg("prediction")).alias("mean"))


@query("weight_hash", "SELECT sha256('[2.0, 3.0, -1.0, 5.0]') AS hash, true AS kept")
def weight_hash(spark, sf_dir):
    m = LinearModel.from_json(_JSON)
    return frame(spark, [(m.weight_hash(), LinearModel.from_json(m.to_json()) == LinearModel(m.features, m.coefficients, m.intercept))], "hash string, kept boolean")


@query("model_roundtrip", "SELECT 'intercept' AS name, round(regr_intercept(o_totalprice, o_custkey), 3) + 0.0e0 AS value FROM orders UNION ALL SELECT 'o_custkey', round(regr_slope(o_totalprice, o_custkey), 3) + 0.0e0 FROM orders")
def model_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/model_roundtrip-{uuid.uuid4().hex}"
    save(spark, LinearRegression().fit(Tables(spark, sf_dir).orders, ["o_custkey"], "o_totalprice"), path)
    return _model(spark, load(spark, path), 3)


# Logistic regression: two classes of orders by a scaled price and key.
_LX = "(SELECT o_totalprice / 100000 AS a, (o_custkey % 10) / 10.0e0 AS b, CAST(o_orderstatus = 'F' AS DOUBLE) AS y, o_orderkey FROM orders)"


def _logistic(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("a"), ((F.col("o_custkey") % 10) / 10.0).alias("b"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


_GD = f"""WITH RECURSIVE g(k, w0, w1, w2) AS (
  SELECT 0, 0.0e0, 0.0e0, 0.0e0
  UNION ALL
  SELECT k + 1, w0 - s * d0, w1 - s * (d1 + w1 / 2.0e0), w2 - s * (d2 + w2 / 2.0e0)
  FROM (SELECT k, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, 1 / (1 + 0.1e0 * k) AS s, avg(p - y) AS d0, avg((p - y) * a) AS d1, avg((p - y) * b) AS d2
        FROM (SELECT g.*, a, b, y, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM g, {_LX} WHERE k < 6) GROUP BY k))
SELECT round(w0, 7) + 0.0e0 AS w0, round(w1, 7) + 0.0e0 AS w1, round(w2, 7) + 0.0e0 AS w2 FROM g WHERE k = 6"""


@query("logreg_gd", _GD)
def logreg_gd(spark, sf_dir):
    m = LogisticRegression(C=2.0, solver="gd", max_iter=6, tol=0.0).fit(_logistic(Tables(spark, sf_dir)), ["a", "b"], "y")
    return rounded(frame(spark, [(m.intercepts[0], *m.coefficients[0])], "w0 double, w1 double, w2 double"), 7)


def _newton(k: int) -> str:
    """Column k of the matrix of second derivatives replaced by the gradient: Cramer's rule, three by three."""
    m = [["h00", "h01", "h02"], ["h01", "h11", "h12"], ["h02", "h12", "h22"]]
    if k >= 0:
        m = [[f"g{i}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(m)]
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


_OPTIMUM = f"""WITH RECURSIVE n(k, w0, w1, w2) AS (
  SELECT 0, 0.0e0, 0.0e0, 0.0e0
  UNION ALL
  SELECT k + 1, w0 - {_newton(0)} / {_newton(-1)}, w1 - {_newton(1)} / {_newton(-1)}, w2 - {_newton(2)} / {_newton(-1)}
  FROM (SELECT k, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, avg(p - y) AS g0, avg((p - y) * a) + any_value(w1) / 2 AS g1, avg((p - y) * b) + any_value(w2) / 2 AS g2,
          avg(p * (1 - p)) AS h00, avg(p * (1 - p) * a) AS h01, avg(p * (1 - p) * b) AS h02, avg(p * (1 - p) * a * a) + 0.5e0 AS h11, avg(p * (1 - p) * a * b) AS h12, avg(p * (1 - p) * b * b) + 0.5e0 AS h22
        FROM (SELECT n.*, a, b, y, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM n, {_LX} WHERE k < 8) GROUP BY k))
SELECT round(w0, 6) + 0.0e0 AS w0, round(w1, 6) + 0.0e0 AS w1, round(w2, 6) + 0.0e0 AS w2 FROM n WHERE k = 8"""


@query("logreg_lbfgs", _OPTIMUM)
def logreg_lbfgs(spark, sf_dir):
    """The optimum of the same objective, by Newton steps."""
    m = LogisticRegression(C=2.0).fit(_logistic(Tables(spark, sf_dir)), ["a", "b"], "y")
    return rounded(frame(spark, [(m.intercepts[0], *m.coefficients[0])], "w0 double, w1 double, w2 double"), 6)


_BIN = ClassifierModel(("a", "b"), (0, 1), ((0.8, -0.4),), (-1.0,))
_MULTI = ClassifierModel(("a", "b"), (0, 1, 2), ((0.5, 0.1), (-0.2, 0.9), (0.05, -0.6)), (0.1, 0.0, 0.4))
_S = "0.5e0 * a + 0.1e0 * b + 0.1e0 AS s0, -0.2e0 * a + 0.9e0 * b AS s1, 0.05e0 * a - 0.6e0 * b + 0.4e0 AS s2"


@query("logreg_predict", f"SELECT CAST(-1 + 0.8e0 * a - 0.4e0 * b >= 0 AS INT) AS prediction, count(*) AS n FROM {_LX} GROUP BY 1")
def logreg_predict(spark, sf_dir):
    return _BIN.predict(_logistic(Tables(spark, sf_dir))).groupBy("prediction").agg(F.count("*").alias("n"))


@query("logreg_proba", f"SELECT y::INT AS y, round(avg(1 / (1 + exp(-(-1 + 0.8e0 * a - 0.4e0 * b)))), 8) + 0.0e0 AS p_1 FROM {_LX} GROUP BY 1")
def logreg_proba(spark, sf_dir):
    return _BIN.predict_proba(_logistic(Tables(spark, sf_dir))).groupBy("y").agg(rnd(F.avg("p_1"), 8).alias("p_1"))


@query("sgdc_decision", f"SELECT y::INT AS y, round(avg(s0), 8) + 0.0e0 AS s0, round(avg(s1), 8) + 0.0e0 AS s1, round(avg(s2), 8) + 0.0e0 AS s2 FROM (SELECT y, {_S} FROM {_LX}) GROUP BY 1")
def sgdc_decision(spark, sf_dir):
    s = _MULTI.scores()
    return _logistic(Tables(spark, sf_dir)).groupBy("y").agg(*[rnd(F.avg(c), 8).alias(f"s{i}") for i, c in enumerate(s)])


_ARG = f"SELECT CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS prediction, count(*) AS n FROM (SELECT {_S} FROM {_LX}) GROUP BY 1"


@query("sgdc_predict", _ARG)
def sgdc_predict(spark, sf_dir):
    return _MULTI.predict(_logistic(Tables(spark, sf_dir))).groupBy("prediction").agg(F.count("*").alias("n"))


@query("pac_predict", _ARG)
def pac_predict(spark, sf_dir):
    return _MULTI.predict(_logistic(Tables(spark, sf_dir)).repartition(4, "y")).groupBy("prediction").agg(F.count("*").alias("n"))


@query("sgdc_proba", f"SELECT y::INT AS y, round(avg(exp(s0) / (exp(s0) + exp(s1) + exp(s2))), 8) + 0.0e0 AS p_0, round(avg(exp(s2) / (exp(s0) + exp(s1) + exp(s2))), 8) + 0.0e0 AS p_2 FROM (SELECT y, {_S} FROM {_LX}) GROUP BY 1")
def sgdc_proba(spark, sf_dir):
    return _MULTI.predict_proba(_logistic(Tables(spark, sf_dir))).groupBy("y").agg(rnd(F.avg("p_0"), 8).alias("p_0"), rnd(F.avg("p_2"), 8).alias("p_2"))


# Naive Bayes on labelled documents, the 40 most frequent ASCII words.
_TOK = "SELECT doc_id, word AS token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')) AS word FROM documents JOIN labels USING (doc_id)) WHERE regexp_matches(word, '^[a-z]+$') GROUP BY ALL"
_NB = f"WITH tok AS ({_TOK}), voc AS (SELECT token FROM tok GROUP BY token ORDER BY sum(n) DESC, token LIMIT 40), cls AS (SELECT quality AS c, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), cnt AS (SELECT quality AS c, token, sum(tok.n) AS n FROM tok JOIN voc USING (token) JOIN labels USING (doc_id) GROUP BY ALL), tot AS (SELECT c, sum(n) AS total FROM cnt GROUP BY c), lp AS (SELECT tot.c, voc.token, ln((coalesce(cnt.n, 0) + {{alpha}}) / (tot.total + {{alpha}} * 40)) AS log_prob FROM tot CROSS JOIN voc LEFT JOIN cnt ON cnt.c = tot.c AND cnt.token = voc.token), pri AS (SELECT c, ln({{prior}}) AS log_prior FROM cls) "
_P, _U = "n / (SELECT sum(n) FROM cls)", "1.0e0 / (SELECT count(*) FROM cls)"


def _nb(t, where="true", **params):
    labelled = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("quality").alias("class")), "doc_id")
    words = labelled.select(F.col("doc_id").alias("doc"), F.explode(ascii_tokens(F.col("text"))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))
    words = written(words, "words")  # read by every part of the fit
    words = words.join(F.broadcast(vocabulary(words, 40)), "token")  # 40 rows
    docs = labelled.select(F.col("doc_id").alias("doc"), "class")
    return MultinomialNB(**params).fit(docs.where(where), words), docs, words


@query("nb_class_prior", _NB.format(alpha="1.0e0", prior=_P) + "SELECT c AS class, round(log_prior, 8) + 0.0e0 AS log_prior FROM pri")
def nb_class_prior(spark, sf_dir):
    return rounded(_nb(Tables(spark, sf_dir))[0].priors(), 8)


@query("nb_uniform_prior", _NB.format(alpha="1.0e0", prior=_U) + "SELECT c AS class, round(log_prior, 8) + 0.0e0 AS log_prior FROM pri")
def nb_uniform_prior(spark, sf_dir):
    return rounded(_nb(Tables(spark, sf_dir), uniform_prior=True)[0].priors(), 8)


@query("nb_feature_log_prob", _NB.format(alpha="1.0e0", prior=_P) + "SELECT c AS class, token, round(log_prob, 8) + 0.0e0 AS log_prob FROM lp")
def nb_feature_log_prob(spark, sf_dir):
    return rounded(_nb(Tables(spark, sf_dir))[0].log_probs(), 8)


@query("nb_alpha", _NB.format(alpha="0.25e0", prior=_P) + "SELECT c AS class, token, round(log_prob, 8) + 0.0e0 AS log_prob FROM lp")
def nb_alpha(spark, sf_dir):
    return rounded(_nb(Tables(spark, sf_dir), alpha=0.25)[0].log_probs(), 8)


@query("nb_partial_fit", _NB.format(alpha="1.0e0", prior=_P) + "SELECT c AS class, token, round(log_prob, 8) + 0.0e0 AS log_prob FROM lp")
def nb_partial_fit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(_nb(t, "doc % 2 = 0")[0].merged(_nb(t, "doc % 2 = 1")[0]).log_probs(), 8)


_JOINT = "sc AS (SELECT d.doc_id, pri.c, log_prior + coalesce((SELECT sum(tok.n * lp.log_prob) FROM tok JOIN lp USING (token) WHERE tok.doc_id = d.doc_id AND lp.c = pri.c), 0) AS s FROM (SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id)) d CROSS JOIN pri) "


@query("nb_predict", _NB.format(alpha="1.0e0", prior=_P).rstrip() + ", " + _JOINT + "SELECT doc_id AS doc, CAST(arg_max(c, s - c * 1e-12) AS INT) AS prediction FROM sc GROUP BY doc_id")
def nb_predict(spark, sf_dir):
    m, docs, words = _nb(Tables(spark, sf_dir))
    return m.predict(words, docs).withColumn("prediction", F.col("prediction").cast("int"))


@query("nb_log_proba", _NB.format(alpha="1.0e0", prior=_P).rstrip() + ", " + _JOINT + "SELECT doc_id AS doc, c AS class, round(s - top - ln(sum(exp(s - top)) OVER (PARTITION BY doc_id)), 6) + 0.0e0 AS log_proba FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM sc)")
def nb_log_proba(spark, sf_dir):
    m, docs, words = _nb(Tables(spark, sf_dir))
    return rounded(m.log_proba(words, docs), 6)


# k-means from the first five vectors.
_KM = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT vec_id AS k, e AS c FROM v WHERE vec_id < 5), d AS (SELECT vec_id, CAST(k AS INT) AS k, list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS d, e FROM v CROSS JOIN c), a AS (SELECT vec_id, arg_min(k, d) AS cluster, min(d) AS d, any_value(e) AS e FROM d GROUP BY vec_id) "


def _vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _centres(t):
    return [list(r["e"]) for r in _vectors(t).where("vec_id < 5").orderBy("vec_id").collect()]  # five rows


@query("kmeans_assign", _KM + "SELECT vec_id, cluster, round(d, 5) + 0.0e0 AS distance FROM a")
def kmeans_assign(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return cluster.assign(_vectors(t), "e", _centres(t)).select("vec_id", "cluster", rnd("distance", 5).alias("distance"))


@query("kmeans_distances", _KM + "SELECT k, round(avg(sqrt(d)), 6) + 0.0e0 AS mean FROM d GROUP BY k")
def kmeans_distances(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = cluster.distances(_vectors(t), "e", _centres(t)).agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(5)])
    return rounded(x.select(F.posexplode(F.array(*[f"d{i}" for i in range(5)])).alias("k", "mean")))


@query("kmeans_inertia", _KM + "SELECT round(sum(d), 3) + 0.0e0 AS inertia, count(*) AS n FROM a")
def kmeans_inertia(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rounded(cluster.inertia(_vectors(t), "e", _centres(t)), 3)


@query("kmeans_lloyd_step", _KM + "SELECT cluster, count(*) AS n, round(avg(e[1]), 6) + 0.0e0 AS c0, round(avg(e[64]), 6) + 0.0e0 AS c63 FROM a GROUP BY cluster")
def kmeans_lloyd_step(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = cluster.lloyd_sums(_vectors(t), "e", _centres(t), 64)
    return x.select("cluster", "n", rnd(F.get("c", F.lit(0))).alias("c0"), rnd(F.get("c", F.lit(63))).alias("c63"))


# CART on orders with their customer's balance.
_TX = "(SELECT c_acctbal AS f0, o_totalprice AS f1, CAST(o_custkey % 10 AS DOUBLE) AS f2, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"
_TF = ["f0", "f1", "f2"]


def _tree_rows(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    x = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", F.col("c_acctbal").alias("f0"), F.col("o_totalprice").alias("f1"), (F.col("o_custkey") % 10).cast("double").alias("f2"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def _split_sql(gini: bool, source: str = _TX) -> str:
    imp = (lambda a, b, n: f"(1 - ({a} / {n}) ** 2 - ({b} / {n}) ** 2)") if gini else (lambda a, b, n: f"-(CASE WHEN {a} > 0 THEN {a} / {n} * log2({a} / {n}) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} / {n} * log2({b} / {n}) ELSE 0 END)")
    return f"""SELECT feature, threshold, gain, CAST(l0 + l1 AS BIGINT) AS n_left FROM (
  SELECT *, round({imp('t0', 't1', '(t0 + t1)')} - (l0 + l1) / (t0 + t1) * {imp('l0', 'l1', '(l0 + l1)')} - (t0 + t1 - l0 - l1) / (t0 + t1) * {imp('(t0 - l0)', '(t1 - l1)', '(t0 + t1 - l0 - l1)')}, 12) AS gain, (v + nx) / 2 AS threshold
  FROM (SELECT feature, v, lead(v) OVER w AS nx, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER (PARTITION BY feature) AS t0, sum(c1) OVER (PARTITION BY feature) AS t1
        FROM (SELECT feature, v, CAST(sum(1 - y) AS DOUBLE) AS c0, CAST(sum(y) AS DOUBLE) AS c1 FROM (SELECT 0 AS feature, f0 AS v, y FROM {source} UNION ALL SELECT 1, f1, y FROM {source} UNION ALL SELECT 2, f2, y FROM {source}) GROUP BY ALL)
        WINDOW w AS (PARTITION BY feature ORDER BY v)) WHERE nx IS NOT NULL)
ORDER BY gain DESC, feature, threshold LIMIT 1"""


def _best(spark, sf_dir, criterion):
    rows = _tree_rows(Tables(spark, sf_dir)).withColumn("node", F.lit(0))
    b = best_splits(candidates(rows, _TF, "y", [0, 1], criterion))
    return b.select("feature", rnd("threshold", 6).alias("threshold"), rnd("gain", 9).alias("gain"), (F.col("l0") + F.col("l1")).alias("n_left"))


_R = "SELECT feature, round(threshold, 6) + 0.0e0 AS threshold, round(gain, 9) + 0.0e0 AS gain, n_left FROM ({})"


@query("tree_best_split_gini", _R.format(_split_sql(True)))
def tree_best_split_gini(spark, sf_dir):
    return _best(spark, sf_dir, "gini")


@query("tree_best_split_entropy", _R.format(_split_sql(False)))
def tree_best_split_entropy(spark, sf_dir):
    return _best(spark, sf_dir, "entropy")


# Depth two: the root's split, then the best split of each side.
_SIDE = "(SELECT x.* FROM {tx} x, root WHERE (CASE root.feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END <= root.threshold) = {side})"
_DEPTH2 = f"WITH root AS ({_split_sql(True)}), lf AS ({_split_sql(True, _SIDE.format(tx=_TX, side='true'))}), rt AS ({_split_sql(True, _SIDE.format(tx=_TX, side='false'))}) "


def _tree2(t):
    return DecisionTreeClassifier(max_depth=2).fit(_tree_rows(t), _TF, "y")


@query("tree_depth2", _DEPTH2 + "SELECT node, feature, round(threshold, 6) + 0.0e0 AS threshold, round(gain, 9) + 0.0e0 AS gain FROM (SELECT 0 AS node, * FROM root UNION ALL SELECT 1, * FROM lf UNION ALL SELECT 2, * FROM rt)")
def tree_depth2(spark, sf_dir):
    nodes = [(n.node_id, n.feature, n.threshold, n.gain) for n in _tree2(Tables(spark, sf_dir)).tree.nodes if not n.leaf]
    return frame(spark, nodes, "node int, feature int, threshold double, gain double").select("node", "feature", rnd("threshold").alias("threshold"), rnd("gain", 9).alias("gain"))


_F = "CASE {s}.feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END <= {s}.threshold"
_LEAF = _DEPTH2 + f", spot AS (SELECT x.y, CASE WHEN {_F.format(s='root')} THEN CASE WHEN {_F.format(s='lf')} THEN 3 ELSE 4 END ELSE CASE WHEN {_F.format(s='rt')} THEN 5 ELSE 6 END END AS leaf FROM {_TX} x, root, lf, rt), shares AS (SELECT leaf, avg(y) AS p FROM spot GROUP BY leaf) "


@query("tree_predict", _LEAF + "SELECT y, CAST(p > 0.5 AS INT) AS prediction, count(*) AS n FROM spot JOIN shares USING (leaf) GROUP BY ALL")
def tree_predict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _tree2(t).predict(_tree_rows(t)).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query("tree_proba", _LEAF + "SELECT y, round(avg(p), 8) + 0.0e0 AS p_1 FROM spot JOIN shares USING (leaf) GROUP BY y")
def tree_proba(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _tree2(t).predict_proba(_tree_rows(t)).groupBy("y").agg(rnd(F.avg("p_1"), 8).alias("p_1"))


@query("tree_importance", _DEPTH2 + f", n AS (SELECT feature, gain * (SELECT count(*) FROM {_TX}) AS d FROM root UNION ALL SELECT feature, gain * (SELECT n_left FROM root) FROM lf UNION ALL SELECT feature, gain * ((SELECT count(*) FROM {_TX}) - (SELECT n_left FROM root)) FROM rt) SELECT f AS feature, round(coalesce(sum(d), 0) / (SELECT sum(d) FROM n), 6) + 0.0e0 AS importance FROM (SELECT unnest([0, 1, 2]) AS f) LEFT JOIN n ON n.feature = f GROUP BY f")
def tree_importance(spark, sf_dir):
    m = _tree2(Tables(spark, sf_dir))
    return rounded(frame(spark, [(i, float(v)) for i, v in enumerate(m.importance())], "feature int, importance double"))


# Pipelines.
_Z = "(SELECT (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS z, l_extendedprice AS y FROM lineitem)"


@query("pipeline_scale_linreg", f"SELECT round(regr_intercept(y, z), 4) + 0.0e0 AS intercept, round(regr_slope(y, z), 4) + 0.0e0 AS slope, round(regr_r2(y, z), 8) + 0.0e0 AS r2 FROM {_Z}")
def pipeline_scale_linreg(spark, sf_dir):
    x = Tables(spark, sf_dir).lineitem.select("l_quantity", "l_extendedprice")
    p = Pipeline([("scale", StandardScaler()), ("fit", LinearRegression())]).fit(x, ["l_quantity"], "l_extendedprice")
    m = p.models[-1]
    return frame(spark, [(m.intercept, m.coefficients[0], p.score(x))], "intercept double, slope double, r2 double").select(rnd("intercept", 4).alias("intercept"), rnd("slope", 4).alias("slope"), rnd("r2", 8).alias("r2"))


@query("pipeline_inverse", "SELECT l_returnflag, round(avg(l_quantity), 6) + 0.0e0 AS q, round(avg(l_tax), 8) + 0.0e0 AS t FROM lineitem GROUP BY 1")
def pipeline_inverse(spark, sf_dir):
    x = Tables(spark, sf_dir).lineitem.select("l_returnflag", "l_quantity", "l_tax")
    p = Pipeline.make(StandardScaler(), MinMaxScaler(-1, 1)).fit(x, ["l_quantity", "l_tax"])
    return p.inverse_transform(p.transform(x)).groupBy("l_returnflag").agg(rnd(F.avg("l_quantity")).alias("q"), rnd(F.avg("l_tax"), 8).alias("t"))


# Cross-validation: five contiguous folds of orders.
_FOLD = "(SELECT CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold, o_totalprice AS y, o_custkey::DOUBLE AS x FROM orders)"
_CV = f"SELECT h.fold, count(*) AS n, avg((y - b - m * x) ** 2) AS mse FROM {_FOLD} h JOIN (SELECT k.fold, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM (SELECT unnest(range(5)) AS fold) k JOIN {_FOLD} f ON f.fold <> k.fold GROUP BY 1) w ON w.fold = h.fold GROUP BY 1"


def _cv(t):
    return selection.cross_validate(t.orders.select("o_orderkey", "o_totalprice", num("o_custkey").alias("x")), "o_orderkey", ["x"], "o_totalprice", 5)


@query("cv_linreg", f"SELECT fold, n, round(mse / 1e6, 4) + 0.0e0 AS mse FROM ({_CV})")
def cv_linreg(spark, sf_dir):
    return frame(spark, [(r["fold"], r["n"], r["mse"] / 1e6) for r in _cv(Tables(spark, sf_dir))], "fold int, n long, mse double").select("fold", "n", rnd("mse", 4).alias("mse"))


@query("cv_summary", f"SELECT round(avg(mse) / 1e6, 4) + 0.0e0 AS mean, round(stddev_samp(mse) / 1e6, 4) + 0.0e0 AS std FROM ({_CV})")
def cv_summary(spark, sf_dir):
    x = frame(spark, [(r["mse"],) for r in _cv(Tables(spark, sf_dir))], "mse double")
    return x.agg(rnd(F.avg("mse") / 1e6, 4).alias("mean"), rnd(F.coalesce(F.stddev_samp("mse"), F.lit(0.0)) / 1e6, 4).alias("std"))


