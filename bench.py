"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds for each query."""

from __future__ import annotations

import json
import os
import time

from larkspur.queries import QUERIES
from larkspur.session import local_session

HEADLINE = ["scan_filter_project", "standard_scaler", "minmax_scaler", "onehot_encode", "linreg_multi", "linreg_predict", "pipeline_scale_linreg", "regression_report", "metric_auc", "metric_ndcg", "class_report", "logreg_gd", "sgdr_fold_squared", "sgdc_fold_hinge", "pac_fold", "ddm_fold", "prequential_error", "nb_predict", "kmeans_assign", "kmeans_lloyd_step", "tree_depth2", "hist_continuous", "gbt_best_split", "gbt_one_round", "gbt_predict", "cv_linreg", "stratified_kfold", "goss_sample"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), int(os.environ.get("BENCH_PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(QUERIES)
    names = list(HEADLINE)
    try:
        from larkspur.llm import entries
    except ModuleNotFoundError:
        entries = None
    if entries:
        queries |= entries.queries()
        names += list(entries.queries())
    for t in ("lineitem", "orders", "events"):  # start the JVM's readers before the clock runs
        spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    out = {}
    for name in names:
        times = []
        for _ in range(1 if name.startswith("op") else 2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        out[name] = round(min(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
