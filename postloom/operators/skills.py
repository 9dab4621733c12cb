"""Posting to one row per skill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S


def explode_skills(detail: DataFrame) -> DataFrame:
    """Split on `|`; the 1-based position counts blank segments, which are then dropped."""
    segments = F.split(F.coalesce(F.col("skills"), F.lit("")), r"\s*\|\s*")
    parents = [c for c in S.SKILL_PARENT_COLUMNS if c in detail.columns]
    return (
        detail.select(*parents, F.posexplode(segments).alias("pos", "segment"))
        .select(*parents, F.trim("segment").alias("skill"), (F.col("pos") + 1).alias("skill_pos"))
        .filter("skill <> ''")
    )
