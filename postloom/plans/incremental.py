"""Statistics kept up to date by the postings that changed.

The table `statistic_count` holds, per scope, statistic and category, sums that can be added and taken away: postings,
postings with a salary, their salaries, and postings that name the category. An update adds the counts of new versions
and takes away those of the versions they replace; only the changed scopes' counts are read and written, and no posting
but the changed ones. The payloads are made from the counts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators.skills import explode_skills
from postloom.plans import statistics as stats
from postloom.sources.tables import Warehouse

_KEY = ["scope_id", "stat_type", "category"]
_SUMS = ["value", "total", "jobs", "known_rows"]


def counted(detail: DataFrame, sign: int = 1) -> DataFrame:
    """The counts of typed postings, all twelve statistics in one form; with sign -1 to be taken away."""
    skills = stats.skill_counts(explode_skills(detail)).select(
        "scope_id", F.lit("skills").alias("stat_type"), "category", "value", F.lit(0).alias("total"), F.lit(0).alias("jobs"), F.lit(0).alias("known_rows")
    )
    rows = stats.category_counts(detail).select(*_KEY, *_SUMS).unionByName(skills)
    typed = {f.name: f.dataType for f in S.STATISTIC_COUNT.fields}
    return rows.select(*_KEY, *[(sign * F.coalesce(c, F.lit(0))).cast(typed[c]).alias(c) for c in _SUMS])


def added_up(parts: DataFrame) -> DataFrame:
    """One row per category; categories without postings go."""
    return parts.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("value > 0")


def update(store: Warehouse, added: DataFrame, removed: DataFrame | None = None) -> list[str]:
    """Adds postings and takes others away; returns the changed scopes, whose names alone reach the driver."""
    delta = counted(added)
    if removed is not None:
        delta = delta.unionByName(counted(removed, -1))
    store.rewrite("statistic_delta", added_up_signed(delta))
    delta = store.read("statistic_delta")
    changed = sorted(r.scope_id for r in delta.select("scope_id").distinct().collect())
    parts = delta
    if store.exists("statistic_count"):
        parts = delta.unionByName(store.read("statistic_count").filter(F.col("scope_id").isin(changed)))
    store.rewrite("statistic_merged", added_up(parts))
    merged = store.read("statistic_merged")
    left = {r.scope_id for r in merged.select("scope_id").distinct().collect()}
    if left:
        store.replace("statistic_count", merged)
    for name in changed:
        if name not in left:
            store.replace("statistic_count", merged.limit(0), S.Scope(name, name))
    return changed


def added_up_signed(parts: DataFrame) -> DataFrame:
    """One row per changed category of a delta."""
    changed = " OR ".join(f"{c} <> 0" for c in _SUMS)
    return parts.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _SUMS]).filter(changed)


def payloads(counts: DataFrame, updated_at: str) -> DataFrame:
    """All twelve statistics of the counts' scopes as payload rows; equal to `statistics` of all their postings."""
    known = counts.withColumn("known", F.col("known_rows") > 0)
    return stats.packed(known.filter("stat_type <> 'skills'"), known.filter("stat_type = 'skills'"), updated_at)
