"""Top-n of category counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import schema as S

GROUP = ["scope_id", "stat_type"]


def _order(group, tie: Column | None):
    ties = ["category"] if tie is None else [tie, "category"]
    return Window.partitionBy(*group).orderBy(F.desc("value"), *ties)


def top(counts: DataFrame, limit: int, group=("scope_id",), tie: Column | None = None) -> DataFrame:
    """Categories with the highest value; pruned per task before the shuffle.

    Ties go by `tie`, then by name. A stable sort of the stored order is `tie=stored_order()`.
    """
    return (
        counts.withColumn("_rn", F.row_number().over(_order(group, tie)))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


def top_with_other(
    counts: DataFrame, limit: int = 6, group=("scope_id",), tie: Column | None = None
) -> DataFrame:
    """The top categories plus one row for the rest when it is above zero.

    Two branches over small inputs instead of ranking a whole group: the kept rows, and the
    group total less what was kept.
    """
    keys = list(group)
    columns = [*keys, "category", "value"]
    kept = top(counts, limit, keys, tie).select(*columns)
    everything = counts.select(*keys, F.col("value"))
    rest = (
        everything.unionByName(kept.select(*keys, (-F.col("value")).alias("value")))
        .groupBy(*keys)
        .agg(F.sum("value").alias("value"))
        .filter("value > 0")
        .withColumn("category", F.lit(S.OTHER))
    )
    return kept.unionByName(rest.select(*columns))
