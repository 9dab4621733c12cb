"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one point of a graph, with the ids of the first few of them; so a vector that many rows share
cannot tear the graph apart. Points are dealt to shards of about `SHARD_ROWS` by a hash. A graph is stored as flat
neighbour arrays, one row per level. Blocks of queries meet every shard; each shard returns its nearest ids with
exact distances, and the best of all shards remain.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take
no part; a query only meets vectors of its own length; rows with the query's id count as its own; ties go to the
smaller id; fewer candidates than k give them all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm import vectors
from postloom.llm.common import settled

SHARD_ROWS = 4096
#: Neighbours of a point (twice as many on the ground level), and candidates kept while building and searching.
DEGREE, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 96


class Graph:
    """Points with a flat neighbour array per level; row i of a level holds the neighbours of point i, -1 for none."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray], entry: int):
        self.points, self.levels, self.entry = points, levels, entry
        self.seen, self.mark = np.zeros(len(points), dtype=np.int64), 0

    def distances(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = self.points[at] - query
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, query: np.ndarray, entries: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The `width` nearest that a best-first walk finds, as (distance, point), nearest first."""
        self.mark += 1
        seen, mark, table = self.seen, self.mark, self.levels[level]
        for _, point in entries:
            seen[point] = mark
        ahead = list(entries)
        heapq.heapify(ahead)
        found = [(-d, p) for d, p in entries]
        heapq.heapify(found)
        while ahead:
            distance, point = heapq.heappop(ahead)
            if len(found) >= width and distance > -found[0][0]:
                break
            near = table[point]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            for d, p in zip(self.distances(query, near).tolist(), near.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (-d, p))
                elif d < -found[0][0]:
                    heapq.heapreplace(found, (-d, p))
                else:
                    continue
                heapq.heappush(ahead, (d, p))
        return sorted((-d, p) for d, p in found)

    def descend(self, query: np.ndarray, bottom: int) -> list[tuple[float, int]]:
        """Greedy walk from the top level down to `bottom` (exclusive)."""
        at = [(float(self.distances(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.levels) - 1, bottom, -1):
            at = self.nearest(query, at, 1, level)
        return at

    def search(self, query: np.ndarray, width: int = SEARCH_WIDTH) -> list[tuple[float, int]]:
        return self.nearest(query, self.descend(query, 0), width, 0)

    def _spread(self, candidates: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates that are nearer to the point than to one taken before; the nearest others fill up."""
        taken: list[int] = []
        left: list[int] = []
        for distance, point in candidates:
            if len(taken) == most:
                break
            if not taken or self.distances(self.points[point], np.array(taken)).min() > distance:
                taken.append(point)
            else:
                left.append(point)
        return taken + left[: most - len(taken)]

    def _link(self, level: int, point: int, other: int) -> None:
        row = self.levels[level][point]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        around = np.r_[row, np.int32(other)]
        apart = self.distances(self.points[point], around)
        order = np.argsort(apart, kind="stable")
        row[:] = -1
        kept = self._spread(list(zip(apart[order].tolist(), around[order].tolist(), strict=True)), len(row))
        row[: len(kept)] = kept

    @classmethod
    def build(cls, points: np.ndarray, seed: int, degree: int = DEGREE, width: int = BUILD_WIDTH) -> Graph:
        n = len(points)
        draws = np.random.default_rng(seed).random(n)
        heights = (-np.log(1 - draws) / np.log(degree)).astype(int)
        top = int(heights.max(initial=0))
        tables = [np.full((n, degree * (1 + (k == 0))), -1, dtype=np.int32) for k in range(top + 1)]
        graph = cls(points, tables[: heights[0] + 1], 0)
        for point in range(1, n):
            query, height = points[point], heights[point]
            at = graph.descend(query, min(height, len(graph.levels) - 1))
            for level in range(min(height, len(graph.levels) - 1), -1, -1):
                at = graph.nearest(query, at, width, level)
                chosen = graph._spread(at, degree)
                graph.levels[level][point, : len(chosen)] = chosen
                for other in chosen:
                    graph._link(level, other, point)
            if height >= len(graph.levels):
                graph.levels, graph.entry = tables[: height + 1], point
        return graph


INDEX = "dim int, shard bigint, entry int, points binary, members array<array<bigint>>, levels array<binary>"
FOUND = "query_id bigint, vec_id bigint, score double"


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its points, the ids of each point (the k + 1 smallest), and the levels of its graph."""
    equal = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    first = rows.withColumn("__at", F.row_number().over(equal)).where(F.col("__at") <= k + 1)
    points = settled(
        first.groupBy("dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    )
    shards = vectors.blocks_of(points.count(), shard_rows)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.argsort([m[0] for m in group["members"]], kind="stable")]
        at = vectors.matrix(np.concatenate(group["embedding"].to_list()), len(group))
        graph = Graph.build(at, seed=int(group["shard"].iloc[0]))
        return pd.DataFrame(
            {
                "dim": [group["dim"].iloc[0]],
                "shard": [group["shard"].iloc[0]],
                "entry": [graph.entry],
                "points": [at.tobytes()],
                "members": [[list(m) for m in group["members"]]],
                "levels": [[table.tobytes() for table in graph.levels]],
            }
        )

    sharded = points.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))
    return settled(sharded.groupBy("dim", "shard").applyInPandas(build, INDEX))


def search(indexed: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that are found for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, graph = None, None
        for batch in batches:
            for row in batch.itertuples():
                if held != (row.dim, row.shard):
                    points = vectors.matrix(np.frombuffer(row.points), len(row.members))
                    tables = [np.frombuffer(t, dtype=np.int32).reshape(len(points), -1) for t in row.levels]
                    held, graph = (row.dim, row.shard), Graph(points, tables, row.entry)
                found = []
                for query_id, query in zip(row.ids, vectors.matrix(row.query_points, len(row.ids)), strict=True):
                    near = graph.search(query, width)
                    at = np.array([p for _, p in near])
                    exact = np.sqrt(graph.distances(query, at))
                    hits = [(d, m) for d, p in zip(exact.tolist(), at, strict=True) for m in row.members[p] if m != query_id]
                    found += [(query_id, m, d) for d, m in heapq.nsmallest(k, hits)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    asked = vectors.query_blocks(queries, indexed, "shard").withColumnRenamed("points", "query_points")
    met = asked.join(indexed, ["dim", "shard"]).sortWithinPartitions("dim", "shard", "block")
    return vectors.best(met.mapInPandas(run, FOUND), k, F.col("score"))


def nearest(df: DataFrame, every: int, k: int) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, against all rows but its own."""
    rows = vectors.usable(df).where(F.exists("embedding", lambda x: x != 0))
    return search(index(rows, k), rows.where(F.col("vec_id") % every == 0), k)
