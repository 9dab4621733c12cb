"""Vectors in blocks: a bounded number of rows packed into one, so that blocks can meet blocks of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block.
QUERY_ROWS = 256


def whole(vector: str) -> Column:
    """True for a vector that is not null and holds neither null nor a non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) and dim of the rows that take part; rows without an id do not."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & whole("embedding")).withColumn("dim", F.size("embedding"))


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def query_blocks(queries: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Blocks of queries, each once per row of `others` (dim and a number `name`) of the same dimension.

    Columns: dim, `name`, block, ids, points. The queries' number sets the number of blocks.
    """
    blocks = blocks_of(queries.count(), QUERY_ROWS)
    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("dim", "block")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
        .select("dim", "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.embedding").alias("points"))
    )
    return packed.join(others.select("dim", name), "dim")


def best(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of every query, with `rank` from 1; each task cuts its own rows first."""
    first = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix(points, rows: int) -> np.ndarray:
    return np.asarray(points, dtype=np.float64).reshape(rows, -1)
