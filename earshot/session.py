"""The session settings that results and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Clock arithmetic is in UTC; adaptive execution joins small partitions, splits skewed ones and re-plans joins by measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "earshot", **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` are further settings, with __ for a dot."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
