"""Distinct filter values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X


def facet_values(df: DataFrame) -> DataFrame:
    """(scope_id, facet, value): distinct non-blank values of five columns from one scan.

    Stays in long form, so a facet with very many values is never gathered into one row.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in S.FACETS.items()]
    )
    return (
        df.select("scope_id", F.inline(pairs))
        .filter(~X.is_blank(F.col("value")))
        .distinct()
    )


def ordered_facets(df: DataFrame, scope_id: str) -> DataFrame:
    return facet_values(df.filter(F.col("scope_id") == scope_id)).orderBy("facet", "value")
