"""A local session with the settings that the operators expect; on a cluster use the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("larkspur")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
