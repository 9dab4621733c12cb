"""Rows as they are shown: labels for blanks, one salary text, skill tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Blank fields replaced by their label."""
    return df.withColumns({c: X.or_label(F.col(c), label) for c, label in labels.items()})


def listing(items: DataFrame) -> DataFrame:
    """Job listing rows as the result table shows them."""
    salary = X.salary_label(F.col("salary_min"), F.col("salary_max"))
    shown = labelled(items, S.LIST_LABELS).withColumn("salary", salary)
    return shown.select(
        "job_id",
        "job_name",
        "company_name",
        "city",
        "salary",
        "education",
        "experience",
        "company_type",
        "publish_time",
    )


def _tags(listed: Column) -> Column:
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(S.NO_SKILLS)))


def key_figures(summary: DataFrame) -> DataFrame:
    """The summary as the overview shows it: grouped numbers, a dash for an absent average or update time."""
    counts = ["job_count", "company_count", "city_count", "salary_job_count"]
    average = F.col("average_annual_salary_wan")
    return summary.select(
        "scope_id",
        *[F.format_number(F.coalesce(c, F.lit(0)), 0).alias(c) for c in counts],
        F.when(average != 0, average.cast("string")).otherwise(S.ABSENT).alias("average_annual_salary_wan"),
        F.coalesce(F.nullif("data_updated_at", F.lit("")), F.lit(S.ABSENT)).alias("data_updated_at"),
    )


def detail(details: DataFrame) -> DataFrame:
    """Job details as the detail view shows them; `skill_tags` holds the first twelve skills, or a label."""
    salary = X.salary_label(F.col("salary_min"), F.col("salary_max"))
    address = F.coalesce(F.nullif("address", F.lit("")), F.col("city"))
    return (
        labelled(details, S.DETAIL_LABELS)
        .withColumns({"salary": salary, "address": address, "skill_tags": _tags(X.skill_list(F.col("skills")))})
        .drop("salary_min", "salary_max", "skills")
    )
