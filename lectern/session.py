"""Session construction and the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Only what changes results or plan quality; sizes (executors, memory, partitions) belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "lectern", **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS and `conf` applied on top."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
