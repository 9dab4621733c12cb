"""Labelled counts and the scope catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def scope_catalog(df: DataFrame) -> DataFrame:
    """Scopes with posting count and last update, most recent first."""
    return (
        df.groupBy("scope_id")
        .agg(
            F.max("keyword").alias("keyword"),
            F.max("city_list").alias("cities"),
            F.count(F.lit(1)).alias("job_count"),
            F.max("created_at").alias("updated_at"),
        )
        .orderBy(F.desc("updated_at"), "scope_id")
    )


def default_scope(df: DataFrame) -> DataFrame:
    return scope_catalog(df).limit(1)
