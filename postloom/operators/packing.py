"""Rows to parallel arrays and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions.payload import envelope

# Categories one payload row holds; the first so many are part 0, the next ones part 1, and so on.
PART_SIZE = 10_000
_KEY = ["scope_id", "stat_type"]
_PART = [*_KEY, "part", "parts"]

_PLAIN = "categories array<string>, values array<bigint>"
_CITY = "categories array<string>, job_counts array<bigint>, average_salary_wan array<double>"


def stored_order() -> Column:
    """Sort key inside a statistic: value descending, but dates ascending and salaries by bucket."""
    labels = F.array(*[F.lit(label) for _, label in S.SALARY_BUCKETS])
    return (
        F.when(F.col("stat_type") == "publish_trend", F.lit(0))
        .when(F.col("stat_type") == "salary", F.array_position(labels, F.col("category")))
        .otherwise(-F.col("value"))
        .cast("long")
    )


def _with_parts(rows: DataFrame, part_size: int) -> DataFrame:
    """Number the payload row each category goes to: ranges of its rank in the stored order.

    Ranks are read off a sort that may spill; no array holds more than `part_size` categories.
    """
    of = Window.partitionBy(*_KEY)
    rank = F.row_number().over(of.orderBy(stored_order(), "category"))
    ranked = rows.withColumn("part", F.floor((rank - 1) / part_size).cast("int"))
    sized = ranked.withColumn("parts", F.ceil(F.count(F.lit(1)).over(of) / part_size).cast("int"))
    return sized.repartition(*[F.col(c) for c in _PART])


def _payload(stat_type: Column, categories: Column, values: Column, averages: Column, stamp: Column) -> Column:
    plain = F.struct(categories.alias("categories"), values.alias("values"))
    city = F.struct(
        categories.alias("categories"), values.alias("job_counts"), averages.alias("average_salary_wan")
    )
    return F.when(stat_type == "city", envelope(city, stamp)).otherwise(envelope(plain, stamp))


def pack(rows: DataFrame, updated_at: str, part_size: int = PART_SIZE) -> DataFrame:
    """Statistic rows to payload rows (scope_id, stat_type, part, parts, payload)."""
    entry = F.struct(stored_order().alias("o"), "category", "value", "average_salary_wan")
    packed = _with_parts(rows, part_size).groupBy(*_PART).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    e = F.col("e")
    payload = _payload(F.col("stat_type"), e["category"], e["value"], e["average_salary_wan"], F.lit(updated_at))
    return packed.select(*_PART, payload.alias("payload"))


def completed(packed: DataFrame, scopes: DataFrame, updated_at: str) -> DataFrame:
    """The payloads, and an empty one for every statistic that a scope lacks, so none can go stale."""
    types = F.array(*[F.lit(t) for t in S.STAT_TYPES if t != "summary"])
    asked = scopes.select("scope_id", F.explode(types).alias("stat_type"))
    none = [F.array().cast(f"array<{t}>") for t in ("string", "bigint", "double")]
    empty = _payload(F.col("stat_type"), *none, F.lit(updated_at))
    return asked.join(packed, _KEY, "left").select(
        *_KEY,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce("payload", empty).alias("payload"),
    )


def pack_summary(summary: DataFrame, updated_at: str) -> DataFrame:
    data = F.struct(*[c for c in summary.columns if c != "scope_id"], F.lit(updated_at).alias("data_updated_at"))
    return summary.select(
        "scope_id",
        F.lit("summary").alias("stat_type"),
        F.lit(0).alias("part"),
        F.lit(1).alias("parts"),
        envelope(data, F.lit(updated_at)).alias("payload"),
    )


def unpack(payloads: DataFrame) -> DataFrame:
    """Payload rows back to (scope_id, stat_type, category, value, average_salary_wan)."""
    rows = payloads.filter(F.col("stat_type") != "summary")
    data = F.from_json("payload", f"data struct<{_PLAIN}, {_CITY.split(', ', 1)[1]}>")["data"]
    value = F.coalesce(data["values"], data["job_counts"])
    zipped = F.arrays_zip(
        data["categories"].alias("category"),
        value.alias("value"),
        F.coalesce(data["average_salary_wan"], F.array().cast("array<double>")).alias("average_salary_wan"),
    )
    return rows.select("scope_id", "stat_type", F.inline(zipped))


def bundle(payloads: DataFrame, stat_types: list[str]) -> DataFrame:
    """One row per scope (and part) with one payload column per statistic type."""
    wanted = payloads.filter(F.col("stat_type").isin(stat_types))
    return wanted.groupBy("scope_id", "part").pivot("stat_type", stat_types).agg(F.max("payload"))
