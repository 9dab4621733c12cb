"""Exact top-k by inner product with vector-approximation files.

Integer vectors are kept in blocks of about `BLOCK_ROWS`. A block holds, besides the vectors, the cell of every
component: `CELLS` equal steps between the block's smallest and largest value of that component. For a query, a scan
of the cells bounds every score from both sides; exact vectors are read in the order of their bounds until the k-th
score is above every bound that is left. Blocks of queries meet every block; the best of all blocks remain.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
a query only meets vectors of its own length; rows with the query's id count as its own; ties go to the smaller id;
fewer candidates than k give them all; scores outside the range of bigint take its nearest value; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import vectors
from postloom.llm.common import settled

BLOCK_ROWS, CELLS, SCALE = 4096, 16, 256
#: Exact vectors read at once.
READ_ROWS = 64
#: Above this, sums of products may lose digits in double precision and integers of any size are used.
EXACT = 2**53

BLOCK = "dim int, part bigint, ids array<bigint>, points binary, cells binary, low binary, step binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def integers(points: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles where they hold every such value exactly, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(points * float(scale))
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled
    return np.vectorize(lambda x: math.floor(x) * scale if abs(x) >= EXACT else math.floor(x * scale), otypes=[object])(points)


def cells_of(values: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every value, and per component the lowest value and the step (whole numbers)."""
    low = values.min(axis=0)
    step = np.maximum((values.max(axis=0) - low) // cells + 1, 1)
    return ((values - low) // step).astype(np.uint8), low, step


def top(query: np.ndarray, floor: np.ndarray, ceil: np.ndarray, values: np.ndarray, ids: np.ndarray, own: int, k: int):
    """(score, id) of the k best: bounds for all, then exact scores in the order of the upper bounds."""
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    most = ceil @ up + floor @ down
    least = floor @ up + ceil @ down
    least[ids == own] = -math.inf
    sure = np.partition(least, -k)[-k] if len(least) >= k and least.dtype != object else -math.inf
    order = np.flatnonzero((most >= sure) & (ids != own))
    order = order[np.argsort(-most[order], kind="stable")]
    best: list[tuple[int, int]] = []
    for at in range(0, len(order), READ_ROWS):
        if len(best) == k and most[order[at]] < -best[-1][0]:
            break
        read = order[at : at + READ_ROWS]
        scores = values[read] @ query
        best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores, ids[read], strict=True)])[:k]
    return [(-s, i) for s, i in best]


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: ids, vectors, their cells, and the components' lowest values and steps."""
    parts = vectors.blocks_of(rows.count(), block_rows)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        points = vectors.matrix(np.concatenate(group["embedding"].to_list()), len(group))
        values = integers(points)
        cells, low, step = cells_of(values) if values.dtype != object else (np.zeros((0, 0), np.uint8), *[np.zeros(0)] * 2)
        row = [group["dim"].iloc[0], group["part"].iloc[0], group["vec_id"].to_list()]
        blobs = [points.tobytes(), cells.tobytes(), low.tobytes(), step.tobytes()]
        return pd.DataFrame([row + blobs], columns=["dim", "part", "ids", "points", "cells", "low", "step"])

    placed = rows.where("dim > 0").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)))
    return settled(placed.groupBy("dim", "part").applyInPandas(build, BLOCK))


def search(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.asarray(row.ids, dtype=np.int64)
                values = integers(vectors.matrix(np.frombuffer(row.points), len(ids)))
                asked = integers(vectors.matrix(row.query_points, len(row.query_ids)))
                size = float(max(np.abs(values).max(), 1)) * float(max(np.abs(asked).max(), 1)) * values.shape[1]
                if size >= EXACT:
                    values, asked = (np.vectorize(int, otypes=[object])(x) for x in (values, asked))
                    floor = ceil = values  # cells of such values would need as many digits
                else:
                    cells = np.frombuffer(row.cells, dtype=np.uint8).reshape(values.shape)
                    low, step = np.frombuffer(row.low), np.frombuffer(row.step)
                    floor = low + cells * step
                    ceil = floor + step - 1
                found = []
                for query_id, query in zip(row.query_ids, asked, strict=True):
                    hits = top(query, floor, ceil, values, ids, query_id, k)
                    found += [(query_id, i, min(max(s, -(2**63)), 2**63 - 1)) for s, i in hits]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    asked = vectors.query_blocks(queries, stored, "part").withColumnsRenamed({"points": "query_points", "ids": "query_ids"})
    met = asked.join(stored, ["dim", "part"])
    return vectors.best(met.mapInPandas(run, FOUND), k, F.col("score").desc())


def highest(df: DataFrame, every: int, k: int) -> DataFrame:
    """The k highest inner products of every row whose vec_id is divisible by `every`, against all rows but its own."""
    rows = vectors.usable(df)
    return search(blocks(rows), rows.where(F.col("vec_id") % every == 0), k)
