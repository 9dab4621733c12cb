"""Left join of facts with a one-row-per-key dimension, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one in this many fact rows, so at most this many are hot.
HOT_SHARE = 1_000


def hot_keys(facts: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than 1/share of the rows: by counting alone there are at most `share`."""
    counts = facts.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = facts.agg(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("count") * share > total).select(key)


def left_lookup(
    facts: DataFrame, dimension: DataFrame, key: str, counted: DataFrame | None = None, share: int = HOT_SHARE
) -> DataFrame:
    """Every fact row with the dimension's columns, null where the key is unknown.

    Hot keys meet their dimension rows, or the news that there is none, in a broadcast bounded by
    `share` rows; all other facts meet the dimension in a shuffle on the key and a place derived from it. Facts that are done,
    or have no key, get a place derived from the whole row instead, so they pass that shuffle
    spread out. Places are hashes, so a task that runs again sends each row to the same one.
    `counted` may name a cheaper frame with the same keys.
    """
    columns = [c for c in dimension.columns if c != key]
    found = F.struct(*columns)
    keys = hot_keys(facts if counted is None else counted, key, share)
    of_hot = dimension.join(F.broadcast(keys), key, "left_semi").select(key, found.alias("_hot"))
    hot = keys.join(of_hot, key, "left").withColumn("_is_hot", F.lit(True))
    marked = facts.join(F.broadcast(hot), key, "left")
    done = F.col("_is_hot").isNotNull() | F.col(key).isNull()
    place = F.when(done, F.xxhash64(*facts.columns)).otherwise(F.xxhash64(key))
    cold = dimension.select(key, found.alias("_cold"), F.xxhash64(key).alias("_place"))
    joined = marked.withColumn("_place", place).join(cold, [key, "_place"], "left")
    row = F.coalesce("_hot", "_cold")
    return joined.select(*facts.columns, *[row[c].alias(c) for c in columns])
