"""Row filters and their composition."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X


def valid_row(keyword: Column, scope_id: Column) -> Column:
    """Numeric raw id, the expected keyword, and both scope codes as expected."""
    return (
        F.col("raw_id").rlike(r"^[0-9]+$")
        & F.col("keyword").isNotNull()
        & (F.trim("keyword") == keyword)
        & (F.col("scope_code") == scope_id)
        & (F.col("scope_id") == scope_id)
    )


def has_uid() -> Column:
    return ~X.is_blank(F.col("job_uid"))


def in_scope(scope_id: str) -> Column:
    return F.col("scope_id") == scope_id


def equals_facet(name: str, value: str | None) -> Column | None:
    """Equality on one facet; a blank value means no filter."""
    value = (value or "").strip()
    return F.col(name) == value if value else None


def matches_keyword(keyword: str | None) -> Column | None:
    """Case-insensitive LIKE over name, company, skills and description."""
    keyword = (keyword or "").strip()
    if not keyword:
        return None
    pattern = X.like_pattern(keyword)
    return reduce(or_, [F.col(c).ilike(pattern) for c in S.SEARCH_COLUMNS])


def _bound(value: float, rounding) -> Column:
    """Amounts have two decimals, so a bound can be moved onto that grid without changing the result.

    Comparing decimal with decimal keeps the predicate free of casts on the column side.
    """
    cents = rounding(Decimal(repr(float(value))) * 100)
    return F.lit(Decimal(cents).scaleb(-2))


def overlaps_salary(low: Column, high: Column, at_least: float | None, at_most: float | None) -> Column | None:
    """Salary range meets the asked range; bounds inclusive, an unknown salary does not match."""
    parts = []
    if at_least is not None:
        parts.append(high >= _bound(at_least, math.ceil))
    if at_most is not None:
        parts.append(low <= _bound(at_most, math.floor))
    return reduce(and_, parts) if parts else None


@dataclass(frozen=True)
class JobQuery:
    """One listing request."""

    scope_id: str
    page: int = 1
    page_size: int = S.DEFAULT_PAGE_SIZE
    city: str = ""
    education: str = ""
    experience: str = ""
    company_size: str = ""
    industry: str = ""
    keyword: str = ""
    salary_min: float | None = None
    salary_max: float | None = None

    def __post_init__(self):
        if not self.scope_id:
            raise ValueError("scope_id is required")
        check_page(self.page, self.page_size)

    def predicate(self) -> Column:
        salary_low = X.wan_amount_anywhere(F.col("salary_low"))
        salary_high = X.wan_amount_anywhere(F.col("salary_high"))
        parts = [
            in_scope(self.scope_id),
            *[equals_facet(f, getattr(self, f)) for f in S.EQUALITY_FACETS],
            matches_keyword(self.keyword),
            overlaps_salary(salary_low, salary_high, self.salary_min, self.salary_max),
        ]
        return reduce(and_, [p for p in parts if p is not None])


def check_page(page: int, page_size: int) -> None:
    if not 1 <= page <= S.MAX_PAGE:
        raise ValueError(f"page must be between 1 and {S.MAX_PAGE}")
    if not 1 <= page_size <= S.MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be between 1 and {S.MAX_PAGE_SIZE}")


def renamed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in fields.items()])


class PostingNotFound(LookupError):
    """No posting has the uid that was asked for."""


def found_detail(df: DataFrame, job_uid: str, scope_id: str | None = None) -> DataFrame:
    """`job_detail`, or an error when there is no such posting; one row at most is looked at."""
    hit = job_detail(df, job_uid, scope_id)
    if hit.isEmpty():
        raise PostingNotFound(job_uid)
    return hit


def job_detail(df: DataFrame, job_uid: str, scope_id: str | None = None) -> DataFrame:
    """One posting by uid; the newest raw id wins when scopes share the uid."""
    hits = df.filter(F.col("job_uid") == job_uid)
    if scope_id is not None:
        hits = hits.filter(in_scope(scope_id))
    newest = hits.orderBy(F.col("raw_id").try_cast("long").desc()).limit(1)
    return renamed(newest, S.DETAIL_FIELDS).withColumn("description", X.plain_text(F.col("description")))
