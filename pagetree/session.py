"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pagetree", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
