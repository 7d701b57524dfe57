"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerloom", **more: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC; the master, memory and shuffle sizes are the cluster's business."""
    builder = SparkSession.builder.appName(name)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (conf | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
