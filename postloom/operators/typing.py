"""Typed projection of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X

_PARSERS = {
    "raw_id": lambda c: c.try_cast("long"),
    "salary_low": X.wan_amount,
    "salary_high": X.wan_amount,
    "publish_time": X.publish_date,
}


def typed(df: DataFrame) -> DataFrame:
    """Parse id, salaries and publish date; bad text becomes null, other columns pass through."""
    columns = []
    for name in df.columns:
        if name in S.TYPED_COLUMNS:
            columns.append(_PARSERS[name](F.col(name)).alias(S.TYPED_COLUMNS[name][0]))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def clean(df: DataFrame) -> DataFrame:
    """Trim every text column, turn blanks into null, and write salaries as amounts in 万 a year."""
    trimmed = df.select(
        *[X.clean_field(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    )
    if not {"salary_low", "salary_high"} <= set(df.columns):
        return trimmed
    low, high = X.normal_salary(F.col("salary_low"), F.col("salary_high"))
    return trimmed.withColumns({"salary_low": low, "salary_high": high})
