"""A session with the settings the jobs here are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "basketry", **conf: str) -> SparkSession:
    """Return a session with adaptive execution on and UTC time stamps.

    ``conf`` may hold any further Spark setting, written with ``__`` for dots,
    for instance ``spark__sql__shuffle__partitions="4000"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a split join may need one more exchange when an aggregate follows it
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
