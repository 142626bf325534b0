"""Session construction with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings of a local run; on a cluster the submitted configuration decides.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = "*", app: str = "nameloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; keyword arguments override DEFAULTS (dots as two underscores)."""
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
