"""City coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom import schema as S


def coordinates(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(city).alias("category"), F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
        for city, (lon, lat) in S.CITY_COORDINATES.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def city_points(city_counts: DataFrame) -> DataFrame:
    """Known cities with position, count and marker size relative to the scope's largest city.

    The dictionary has 24 fixed rows, so the broadcast cannot grow, nor can the window's groups.
    """
    placed = city_counts.join(F.broadcast(coordinates(city_counts.sparkSession)), "category")
    largest = F.greatest(F.lit(1), F.max("value").over(Window.partitionBy("scope_id")))
    return placed.select(
        "scope_id",
        F.col("category").alias("name"),
        "lon",
        "lat",
        "value",
        (5 + 12 * F.sqrt(F.col("value") / largest)).alias("symbol_size"),
    )
