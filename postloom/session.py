"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # AQE merges small shuffle partitions, splits skewed ones and re-plans joins by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # ANSI stays on: every cast of outside text is a try_cast.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.orc.filterPushdown": "true",
    # Scope codes are text even when they look like numbers.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def builder(name: str = "postloom", initial_partitions: int = 8_000) -> SparkSession.Builder:
    """Builder for a cluster; start with many shuffle partitions and let AQE merge them."""
    made = SparkSession.builder.appName(name)
    made = made.config("spark.sql.shuffle.partitions", initial_partitions)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made
