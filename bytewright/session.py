"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(master: str = "local[*]", name: str = "bytewright", **settings: str) -> SparkSession:
    """Settings given with underscores for dots, such as ``spark_sql_shuffle_partitions="8"``, win over ``SETTINGS``."""
    builder = SparkSession.builder.master(master).appName(name)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
