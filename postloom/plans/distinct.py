"""Exact distinct counts that merge over days and scopes.

The dictionary gives every known value of a counted column a number, once and for all; numbers lie close together, so
32,768 of them share one bitmap of 4 KB. The table of bitmaps holds, per day, scope and column, the numbers that occur.
Counting over any set of days and scopes is a union of bitmaps and reads no posting.

Rows are folded to distinct (day, scope, value) before they meet the dictionary, so a value in very many rows is one
row a day and scope there. Every day is a folder; where days hold few postings, pass dates cut to months. A null or blank value counts nowhere; postings without a date are a day of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.sources.tables import Warehouse

COLUMNS = ("company", "city")
DICTIONARY = "kind string, value string, number bigint"
BITMAPS = "scope_id string, kind string, bucket bigint, bits binary, day date"
#: Numbers that share a bitmap; fixed by `bitmap_bit_position`.
WIDTH = 32_768


def _read(store: Warehouse, table: str, schema: str) -> DataFrame:
    """The stored rows; none before the first write."""
    if not store.exists(table):
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).format(store.fmt).load(store.path(table))


def dictionary(store: Warehouse) -> DataFrame:
    return _read(store, "distinct_value", DICTIONARY)


def bitmaps(store: Warehouse) -> DataFrame:
    """Stored bitmaps; the marks of days without values are left out."""
    return _read(store, "distinct_bitmap", BITMAPS).filter("kind IS NOT NULL")


def occurring(rows: DataFrame, columns=COLUMNS) -> DataFrame:
    """Distinct (day, scope_id, kind, value) of postings with publish_date."""
    named = F.array(*[F.struct(F.lit(c).alias("kind"), X.known_value(F.col(c)).alias("value")) for c in columns])
    each = rows.select(F.col("publish_date").alias("day"), "scope_id", F.inline(named))
    return each.filter("value IS NOT NULL").distinct()


def update(store: Warehouse, rows: DataFrame, days: DataFrame | None = None) -> None:
    """Replaces the bitmaps of the days in `rows`, which holds all postings of these days.

    days: further days (column `day`), which may have no posting left.
    """
    touched = rows.select(F.col("publish_date").alias("day"))
    touched = (touched if days is None else touched.union(days.select("day"))).distinct()
    found = occurring(rows)
    known = dictionary(store)
    new = found.select("kind", "value").distinct().join(known, ["kind", "value"], "left_anti")
    last = known.agg(F.max("number")).first()[0]  # one number
    first = 0 if last is None else (last // WIDTH + 1) * WIDTH
    # Read back before use: the numbers are given anew whenever the plan runs.
    numbered = new.select("kind", "value", (F.monotonically_increasing_id() + first).alias("number"))
    numbered.write.mode("append").format(store.fmt).save(store.path("distinct_value"))

    number = F.col("number") + 1  # the functions count from one
    made = (
        found.join(dictionary(store), ["kind", "value"])
        .groupBy("day", "scope_id", "kind", F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("scope_id", "string"), ("kind", "string"), ("bucket", "bigint"), ("bits", "binary"))]
    marks = touched.select("day", *empty)  # so that a day without values is replaced as well
    rows_of_days = made.unionByName(marks).hint("rebalance", "day").select("scope_id", "kind", "bucket", "bits", "day")
    writer = rows_of_days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
    writer.format(store.fmt).save(store.path("distinct_bitmap"))


def counted(maps: DataFrame, *by: str, columns=COLUMNS) -> DataFrame:
    """Distinct values of every column per group of bitmap rows, as `<column>_count`."""
    merged = maps.groupBy(*by, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == c, F.col("n"))), F.lit(0)).alias(f"{c}_count") for c in columns]
    return merged.groupBy(*by).agg(*sums)
