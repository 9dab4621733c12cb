"""The twelve dashboard statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X
from postloom.operators.packing import completed, pack, pack_summary
from postloom.operators.ranking import GROUP, top

ROW = ["scope_id", "stat_type", "category", "value", "average_salary_wan"]


def salary_total() -> Column:
    """low + high, twice the posting's average salary; null unless both are known."""
    return F.col("salary_low_wan") + F.col("salary_high_wan")


def average_salary(total: Column, jobs: Column) -> Column:
    return F.when(jobs > 0, total.cast("double") / (2 * jobs))


def salary_bucket() -> Column:
    """Label of the bucket that holds the posting's average salary."""
    total = salary_total()
    label = F.when(total < 0, None)
    for bound, name in S.SALARY_BUCKETS:
        if bound is not None:
            label = label.when(total < 2 * bound, name)
    return label.when(total.isNotNull(), S.SALARY_BUCKETS[-1][1])


def category(stat_type: str) -> Column:
    """Value a posting adds to a statistic; a blank counts as unknown, so counts add up."""
    if stat_type == "salary":
        return salary_bucket()
    if stat_type == "publish_trend":
        return F.col("publish_date").cast("string")
    return F.coalesce(X.known_value(F.col(S.CATEGORY_COLUMN[stat_type])), F.lit(S.UNKNOWN))


def has_category(stat_type: str) -> Column:
    """Whether a posting counts at all; kept apart from `category`, so the filter stays cheap."""
    if stat_type == "salary":
        return salary_total() >= 0
    if stat_type == "publish_trend":
        return F.col("publish_date").isNotNull()
    return F.lit(True)


def distribution(detail: DataFrame, stat_type: str) -> DataFrame:
    """(scope_id, category, value) of one statistic, every category."""
    return (
        detail.filter(has_category(stat_type))
        .groupBy("scope_id", category(stat_type).alias("category"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def ranked(detail: DataFrame, stat_type: str) -> DataFrame:
    return top(distribution(detail, stat_type), S.TOP_LIMIT[stat_type])


def city(detail: DataFrame) -> DataFrame:
    """Postings and average salary per city."""
    return (
        detail.groupBy("scope_id", category("city").alias("category"))
        .agg(
            F.count(F.lit(1)).alias("value"),
            F.sum(salary_total()).alias("total"),
            F.count(salary_total()).alias("jobs"),
        )
        .select(
            "scope_id",
            "category",
            "value",
            average_salary(F.col("total"), F.col("jobs")).alias("average_salary_wan"),
        )
    )


def summary(detail: DataFrame) -> DataFrame:
    """Totals per scope. Distinct counts are pre-aggregated per (scope, value) by Spark."""
    return detail.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.countDistinct(X.known_value(F.col("company"))).alias("company_count"),
        F.countDistinct(X.known_value(F.col("city"))).alias("city_count"),
        average_salary(F.sum(salary_total()), F.count(salary_total())).alias("average_annual_salary_wan"),
        F.count(salary_total()).alias("salary_job_count"),
    )


def skill_counts(skill_rows: DataFrame) -> DataFrame:
    return skill_rows.groupBy("scope_id", F.col("skill").alias("category")).agg(F.count(F.lit(1)).alias("value"))


def skills(skill_rows: DataFrame, limit: int = S.TOP_LIMIT["skills"]) -> DataFrame:
    return top(skill_counts(skill_rows), limit)


def fill_trend(per_day: DataFrame, days: int = S.TREND_DAYS) -> DataFrame:
    """The last `days` days of each scope up to its newest date, zero-filled.

    `per_day` holds (scope_id, day, value); after the cut-off at most `days` rows per scope are
    gathered, and the gaps are filled from a map instead of by a join.
    """
    newest = F.max("day").over(Window.partitionBy("scope_id"))
    return (
        per_day.withColumn("newest", newest)
        .filter(F.col("day") > F.date_sub("newest", days))
        .groupBy("scope_id", "newest")
        .agg(F.map_from_entries(F.collect_list(F.struct("day", "value"))).alias("found"))
        .select("scope_id", "found", F.explode(F.expr(f"sequence(newest - {days - 1}, newest)")).alias("day"))
        .select(
            "scope_id",
            F.col("day").cast("string").alias("category"),
            F.coalesce(F.try_element_at("found", F.col("day")), F.lit(0)).alias("value"),
        )
    )


def publish_trend(detail: DataFrame, date: str = "publish_date") -> DataFrame:
    per_day = (
        detail.filter(F.col(date).isNotNull())
        .groupBy("scope_id", F.col(date).alias("day"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return fill_trend(per_day)


_COUNTED = [*S.CATEGORY_COLUMN, "salary", "publish_trend"]


def category_counts(detail: DataFrame) -> DataFrame:
    """Counts behind ten statistics and the summary, from one scan and one shuffle.

    Every posting yields one (position, category) pair per statistic; the map side folds them
    into per-task counts before anything moves. Salaries are summed per city only, and only
    cities and companies are told apart from the label of a blank. The type comes out of an
    aggregate, so filters on it stay above the shuffle, and all branches reuse that shuffle.
    """
    at = F.col("at")
    is_city, is_company = (at == _COUNTED.index(t) for t in ("city", "top_companies"))
    total = F.when(is_city, F.col("total"))
    known = F.when(is_city, F.col("city_known")).when(is_company, F.col("company_known"))
    names = F.array(*[F.lit(t) for t in _COUNTED])
    return (
        detail.select(
            "scope_id",
            salary_total().alias("total"),
            (~X.is_blank(F.col("city"))).alias("city_known"),
            (~X.is_blank(F.col("company"))).alias("company_known"),
            F.posexplode(F.array(*[category(t) for t in _COUNTED])).alias("at", "category"),
        )
        .filter(F.col("category").isNotNull())
        .groupBy("scope_id", "at", "category")
        .agg(
            F.count(F.lit(1)).alias("value"),
            F.sum(total).alias("total"),
            F.count(total).alias("jobs"),
            F.max(known).alias("known"),
            F.count_if(known).alias("known_rows"),
            F.max(at).alias("type"),
        )
        .withColumn("stat_type", F.get(names, F.col("type")))
        .select("scope_id", "stat_type", "category", "value", "total", "jobs", "known", "known_rows")
    )


def _summary_from(counts: DataFrame) -> DataFrame:
    is_city = F.col("stat_type") == "city"
    is_company = F.col("stat_type") == "top_companies"
    jobs = F.sum(F.when(is_city, F.col("jobs")))
    return (
        counts.filter(is_city | is_company)
        .groupBy("scope_id")
        .agg(
            F.sum(F.when(is_city, F.col("value"))).alias("job_count"),
            F.count_if(is_company & F.col("known")).alias("company_count"),
            F.count_if(is_city & F.col("known")).alias("city_count"),
            average_salary(F.sum(F.when(is_city, F.col("total"))), jobs).alias("average_annual_salary_wan"),
            jobs.alias("salary_job_count"),
        )
    )


def statistic_rows(counts: DataFrame, skill_rows: DataFrame) -> DataFrame:
    """Rows of every statistic but the summary: (scope_id, stat_type, category, value, average)."""
    return rows_of(counts, skill_counts(skill_rows))


def rows_of(counts: DataFrame, skill_totals: DataFrame) -> DataFrame:
    """The same from (scope_id, category, value) of every skill."""
    stat_type = F.col("stat_type")
    no_average = F.lit(None).cast("double").alias("average_salary_wan")
    ranked_types = ["top_companies", "industry"]
    average = F.when(stat_type == "city", average_salary(F.col("total"), F.col("jobs")))
    whole = counts.filter(~stat_type.isin(*ranked_types, "publish_trend")).select(*ROW[:-1], average.alias(ROW[-1]))
    best = [
        top(counts.filter(stat_type == t), S.TOP_LIMIT[t], GROUP).select(*ROW[:-1], no_average) for t in ranked_types
    ]
    days = counts.filter(stat_type == "publish_trend").select(
        "scope_id", F.col("category").try_cast("date").alias("day"), "value"
    )
    trend = fill_trend(days).withColumn("stat_type", F.lit("publish_trend")).select(*ROW[:-1], no_average)
    best_skills = top(skill_totals.select("scope_id", "category", "value"), S.TOP_LIMIT["skills"])
    skill = best_skills.withColumn("stat_type", F.lit("skills")).select(*ROW[:-1], no_average)
    return reduce(DataFrame.unionByName, [whole, *best, trend, skill])


def statistics(detail: DataFrame, skill_rows: DataFrame, updated_at: str) -> DataFrame:
    """All twelve statistics of every scope as payload rows; one that counts nothing is empty."""
    return packed(category_counts(detail), skill_counts(skill_rows), updated_at)


def packed(counts: DataFrame, skill_totals: DataFrame, updated_at: str) -> DataFrame:
    """The payload rows of `category_counts` and the counts of skills."""
    totals = _summary_from(counts)
    rows = pack(rows_of(counts, skill_totals), updated_at)
    return completed(rows, totals, updated_at).unionByName(pack_summary(totals, updated_at))
