"""Latest-version-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key, the one with the highest version.

    The filter on `row_number` makes Spark keep one row per key in every map task before the
    shuffle, so a key with very many copies does not pile up in one reducer.
    """
    order = Window.partitionBy(*keys).orderBy(version.desc())
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def latest_postings(df: DataFrame) -> DataFrame:
    """Newest row per scope and job uid, by numeric raw id."""
    return latest(df, ["scope_code", "job_uid"], F.col("raw_id").try_cast("long"))
