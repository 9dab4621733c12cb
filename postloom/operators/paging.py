"""Pages of an ordered listing and their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.filters import check_page

#: A day of more rows than this is divided by the second before its rows are sorted.
DAY_ROWS = 100_000
_DAY = 86_400


def with_order_columns(df: DataFrame) -> DataFrame:
    """`published_at` and `raw_number`, what listings are ordered by; stored tables have them already."""
    made = {
        "published_at": F.col("publish_time").try_cast("timestamp_ntz") if "published_at" not in df.columns else None,
        "raw_number": F.col("raw_id").try_cast("long") if "raw_number" not in df.columns else None,
    }
    return df.withColumns({c: e for c, e in made.items() if e is not None})


def newest_first() -> list[Column]:
    """Order for frames that hold the text columns only."""
    at, number = F.col("publish_time").try_cast("timestamp_ntz"), F.col("raw_id").try_cast("long")
    return [at.desc_nulls_last(), number.desc_nulls_last()]


def _second(at: Column) -> Column:
    return F.unix_date(at.cast("date")).cast("long") * _DAY + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at))


def _range(counts: Sequence[tuple[int | None, int]], first: int, last: int) -> tuple[list, int]:
    """Keys, newest first and null at the end, that hold the positions first to last; rows before them."""
    before, keys = 0, []
    for key, rows in sorted(counts, key=lambda x: (x[0] is None, -(x[0] or 0))):
        if before + rows > first and before <= last:
            keys.append((key, before))
        before += rows
    return [k for k, _ in keys], keys[0][1] if keys else before


def _between(keys: list, unit: int) -> Column:
    """Rows published in the units of the keys: literal bounds of the time stamp, so they reach the scan."""
    at = F.col("published_at")
    known = [k for k in keys if k is not None]
    bound = F.lit(False)
    if known:
        low, high = (F.expr(f"timestamp_ntz '1970-01-01' + make_dt_interval(0, 0, 0, {s})")
                     for s in (min(known) * unit, (max(known) + 1) * unit))
        bound = (at >= low) & (at < high)
    return bound | at.isNull() if None in keys else bound


def page(df: DataFrame, number: int, size: int, day_rows: int = DAY_ROWS) -> DataFrame:
    """Page of postings, newest first, ties by raw id, at any depth in at most three jobs.

    One count per day says which days hold the page; only these are read again, by bounds on the time stamp. Where
    they hold more than `day_rows`, a count per second of these days narrows the bounds once more. Only counts reach
    the driver: one per calendar day, and one per second of the days of one page.
    """
    check_page(number, size)
    first, columns = (number - 1) * size, df.columns
    rows = with_order_columns(df)
    at = F.col("published_at")
    day = F.unix_date(at.cast("date")).cast("long")
    counts = [tuple(r) for r in rows.groupBy(day.alias("day")).count().collect()]
    days, before = _range(counts, first, first + size - 1)
    if not days:
        return df.limit(0)
    inside = _between(days, _DAY)
    if sum(n for k, n in counts if k in days) > day_rows:
        seconds = rows.filter(inside).groupBy(_second(at).alias("second")).count().collect()
        exact, earlier = _range([tuple(r) for r in seconds], first - before, first - before + size - 1)
        before += earlier
        inside = _between(exact, 1)
    ordered = rows.filter(inside).orderBy(at.desc_nulls_last(), F.col("raw_number").desc_nulls_last())
    return ordered.offset(first - before).limit(size).select(*columns)


def page_meta(df: DataFrame, number: int, size: int) -> DataFrame:
    """(total, page, page_size, pages) of a filtered frame."""
    check_page(number, size)
    return _with_pages(df.agg(F.count(F.lit(1)).alias("total")), number, size)


def page_meta_by_scope(df: DataFrame, number: int, size: int) -> DataFrame:
    check_page(number, size)
    return _with_pages(df.groupBy("scope_id").agg(F.count(F.lit(1)).alias("total")), number, size)


def _with_pages(totals: DataFrame, number: int, size: int) -> DataFrame:
    pages = F.expr(f"greatest(1L, (total + {size} - 1) div {size})")
    return (
        totals.withColumn("page", F.lit(number).cast("long"))
        .withColumn("page_size", F.lit(size).cast("long"))
        .withColumn("pages", pages)
    )


def recent(df: DataFrame, per_scope: int = 5) -> DataFrame:
    """The newest postings of every scope."""
    order = Window.partitionBy("scope_id").orderBy(*newest_first())
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_scope).drop("_rn")
