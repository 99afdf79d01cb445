"""A session with the settings that the plans of this package are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """AQE with coalescing and skew joins; everything else is the cluster's own."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.config(map=base | conf)
    return (builder.master(master) if master else builder).getOrCreate()
