import os
from pathlib import Path

import duckdb
import pytest
from oracle import check

from larkspur.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir):
    check(QUERIES[name], ORACLES[name], spark, sf_dir)


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == {"gbt_regression"}


def test_boosting_loss_falls(spark, sf_dir):
    losses = [r["mse"] for r in QUERIES["gbt_regression"](spark, sf_dir).orderBy("round").collect()]
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]


def test_logistic_optimum(spark, sf_dir):
    import numpy as np

    from larkspur.queries.estimators import _logistic
    from larkspur.queries.registry import Tables

    w = np.array(QUERIES["logreg_lbfgs"](spark, sf_dir).first())
    x = _logistic(Tables(spark, sf_dir)).toPandas()
    a = np.c_[np.ones(len(x)), x["a"], x["b"]]
    g = a.T @ (1 / (1 + np.exp(-a @ w)) - x["y"]) / len(x) + np.r_[0, w[1:] / 2]
    assert np.abs(g).max() < 1e-5


def test_stream_sgd_covers_all_rows(spark, sf_dir):
    out = QUERIES["stream_sgdr"](spark, sf_dir).collect()
    assert sum(r["n"] for r in out) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.fixture
def events(tmp_path, monkeypatch):
    """Writes a folder with a table of events alone."""
    monkeypatch.setattr("oracle.TABLES", ["events"])

    def write(sql):
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/events.parquet'")
        return str(tmp_path)

    return write


def test_unbundle_large_value(spark, sf_dir, events):
    """One value beyond half of what a feature's room was."""
    d = events(f"SELECT * REPLACE (CASE WHEN event_id = 25 THEN 5000 ELSE value END AS value) FROM '{sf_dir}/events.parquet'")
    check(QUERIES["efb_unbundle"], ORACLES["efb_unbundle"], spark, d)


@pytest.mark.parametrize("name", ["kmeans_online", "stream_kmeans"])
def test_kmeans_tie(name, spark, events):
    """The last row of the second user is as far from one centre as from the other but for rounding."""
    ids = [[84 * k + next(i for i in range(0, 84, 4) if i % 21 == r) for k, r in enumerate(rest)] for rest in ([1, 2, 3], [11, 15, 6, 12, 10])]
    d = events(" UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, {u}::BIGINT AS user_id, 'view' AS event_type, 1e0 AS value" for u, own in enumerate(ids) for i in own))
    check(QUERIES[name], ORACLES[name], spark, d)


@pytest.mark.parametrize("name", ["stream_kmeans", "stream_sgdr"])
def test_stream_order_without_times(name, spark, sf_dir, monkeypatch):
    """Files of a later batch may bear an earlier time: a clock was set back."""
    from larkspur.queries import streams

    opened = streams.S.file_stream

    def set_back(spark, path, *more):
        files = sorted(Path(path.removeprefix("file://")).glob("*.parquet"), key=lambda f: f.stat().st_ctime_ns)
        for k, f in enumerate(files):
            os.utime(f, (1.7e9 - 60 * k,) * 2)
        return opened(spark, path, *more)

    monkeypatch.setattr(streams.S, "file_stream", set_back)
    check(QUERIES[name], ORACLES[name], spark, sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
