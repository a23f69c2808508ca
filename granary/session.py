"""Session builder with the settings that every query of this library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that decide results (time zone) or let Spark re-plan at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "granary", cores: int | None = None, **settings: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own and the operators only read its settings."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | settings
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
