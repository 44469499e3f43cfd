"""The Spark session that the engine expects, for programs that do not bring their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session; local[*] unless a master is given. On a cluster, partitions is left to AQE."""
    cores = os.cpu_count() or 8
    b = SparkSession.builder.appName("siltstone").master(master or "local[*]")
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or cores))
    return b.config(map=CONF | conf).getOrCreate()
