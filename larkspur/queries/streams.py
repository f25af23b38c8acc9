"""Streaming queries: Parquet tables read as files of a stream, run over all that is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import streaming as S
from ..frame import shared_dir
from ..operators.folds import OnlineKMeans, PassiveAggressive, SGDClassifier, SGDRegressor
from ..operators.linear import LinearModel
from .online import _events, _kmeans_sql, _pac_sql, _sgd_sql, _sgdc_sql
from .registry import Tables, frame, query, rnd, rounded


#: More files than a micro-batch has.
_ALL = 1_000_000


def _folder(spark, name: str) -> str:
    """A new folder in the shared one that the session names."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark, df, n: int) -> str:
    path = _folder(spark, "stream")
    df.repartition(n).write.parquet(path)
    return path


@query("stream_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0e0 AS mean FROM events WHERE value > 10 GROUP BY 1")
def stream_metrics(spark, sf_dir):
    source = S.file_stream(spark, _files(spark, Tables(spark, sf_dir).events, 4), 2)
    out = _folder(spark, "sink")
    S.collect_stream(S.staged(source, lambda d: d.where("value > 10"), lambda d: d.select("event_type", "value")), out, _folder(spark, "offsets"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), rnd(F.avg("value")).alias("mean"))


@query("stream_predict", "SELECT o_orderstatus, count(*) AS n, round(avg(2 + 0.5e0 * o_totalprice), 4) + 0.0e0 AS mean FROM orders GROUP BY 1")
def stream_predict(spark, sf_dir):
    source = S.file_stream(spark, _files(spark, Tables(spark, sf_dir).orders.select("o_orderstatus", "o_totalprice"), 3), 1)
    out = _folder(spark, "sink")
    S.collect_stream(S.predict_stream(source, LinearModel(("o_totalprice",), (0.5,), 2.0)), out, _folder(spark, "offsets"))
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count("*").alias("n"), rnd(F.avg("prediction"), 4).alias("mean"))


@query("stream_linreg", "SELECT count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0e0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0e0 AS slope FROM lineitem")
def stream_linreg(spark, sf_dir):
    source = S.file_stream(spark, _files(spark, Tables(spark, sf_dir).lineitem.select("l_quantity", "l_extendedprice"), 4), 1)
    m = S.StreamingLinearRegression(["l_quantity"], "l_extendedprice").fit_stream(source, _folder(spark, "offsets"))
    x = frame(spark, [(m.rows, m.model().intercept, m.model().coefficients[0])], "n long, intercept double, slope double")
    return x.select("n", rnd("intercept", 3).alias("intercept"), rnd("slope", 4).alias("slope"))


def _in_batches(spark, sf_dir, learn):
    """Run learn over the events as a stream of four micro-batches, by event_id % 4; what each run returns.

    A batch is written when the one before it is learnt, so that the order does not rest on the times of files.
    """
    path, e, out = _folder(spark, "stream"), _events(Tables(spark, sf_dir)).withColumn("y", F.col("y").cast("double")), []
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).write.mode("append").parquet(path)
        out.append(learn(S.file_stream(spark, path, _ALL)))
    return out


#: The same order in SQL: batch by batch, by event_id within a batch.
_BY_BATCH = "event_id % 4, event_id"
_TRIED = """, firsts AS (SELECT user_id, event_id % 4 AS part, min(rn) - 1 AS rn FROM rows GROUP BY ALL)
SELECT CAST(part AS INT) AS batch, count(*) AS n, count(f.rn) FILTER (WHERE f.rn > 0) AS tested, round(avg(CASE WHEN f.rn > 0 THEN (b + w0 * x + w1 * z - y) ** 2 END), 6) + 0.0e0 AS mse
FROM rows JOIN firsts USING (user_id) JOIN f ON f.user_id = rows.user_id AND f.rn = firsts.rn WHERE event_id % 4 = part GROUP BY part"""


@query("stream_sgdr", _sgd_sql("squared_error", _TRIED, _BY_BATCH))
def stream_sgdr(spark, sf_dir):
    """Test-then-train error of each micro-batch."""
    s = S.StreamingFold(SGDRegressor(eta0=0.05), ["x", "z"], "y", "user_id", "event_id")
    offsets = _folder(spark, "offsets")
    out = _in_batches(spark, sf_dir, lambda stream: s.test_then_train(stream, offsets))
    return rounded(frame(spark, sum(out, []), "batch int, n long, tested long, mse double"))


def _fitted(spark, sf_dir, learner, target):
    s, offsets = S.StreamingFold(learner, ["x", "z"], target, "user_id", "event_id"), _folder(spark, "offsets")
    _in_batches(spark, sf_dir, lambda stream: s.fit_stream(stream, offsets))
    return s.result(spark)


def _values(df, names, first=0):
    return rounded(df.select(F.col("k").alias("user_id"), *[F.get("state", F.lit(i + first)).alias(n) for i, n in enumerate(names)]), 7)


_TWO = ["b0", "w0_0", "w0_1", "b1", "w1_0", "w1_1"]


@query("stream_sgdc", _sgdc_sql("hinge", _BY_BATCH).replace("user_id, rn AS n,", "user_id,"))
def stream_sgdc(spark, sf_dir):
    return _values(_fitted(spark, sf_dir, SGDClassifier([0, 1], "hinge", eta0=0.05), "c"), _TWO, 1)


@query("stream_pac", _pac_sql(_BY_BATCH))
def stream_pac(spark, sf_dir):
    return _values(_fitted(spark, sf_dir, PassiveAggressive(classes=[0, 1]), "c"), _TWO)


@query("stream_kmeans", _kmeans_sql(_BY_BATCH))
def stream_kmeans(spark, sf_dir):
    return _values(_fitted(spark, sf_dir, OnlineKMeans([[0.0, 0.0], [1.0, 1.0]]), None), ["n0", "n1", "c0_0", "c0_1", "c1_0", "c1_1"])
