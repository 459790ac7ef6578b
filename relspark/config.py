"""Session settings the engine is meant to run with; a cluster's own settings win where they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC", "spark.sql.parquet.filterPushdown": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply(spark: SparkSession, **own: str) -> SparkSession:
    """Sets ``SETTINGS`` and ``own`` (with ``__`` for dots) on a running session."""
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in own.items()}).items():
        spark.conf.set(k, v)
    return spark
