"""Hard negatives of anchors, found with rotated one-bit codes.

Rows are stored in blocks. In a block every vector is centred on the mean of the block's rows of its label and turned
by a fixed random rotation; stored are the signs of the turned residual (its code, one bit a component), the length of
the residual's projection on the code vector (the alignment) and the length of what the projection leaves (the rest).
An anchor, turned and cut into bit planes, meets a code by popcounts. That gives the inner product up to

    alignment * (error of the planes) + rest * (what the anchor has beside the code vector),

the second by Cauchy-Schwarz, so the interval is certain and not a likelihood. Rows whose interval cannot reach the
wanted places are left out; all others are scored with whole numbers. First the positives of every anchor are found
so, then, between the bounds that each positive's score sets, its negatives.

Blocks of anchors meet every block of rows. Equal vectors of one label are one point of a block with their smallest
ids, as many as any result can need, so a vector that very many rows share is scored once.

Defined results: rows with a null vec_id, a null label, a null vector or null or non-finite components take no part;
of rows with one vec_id the one with the smallest (label, vector) takes part; a row only meets vectors of its own
length; empty vectors meet no one; ties go to the smaller id; an anchor without positives, or a positive without
negatives in its bounds, has no row; values too large for exact products in double precision are multiplied as
integers of any size, and scores outside bigint take its nearest value, which bounds then follow; an empty table
gives an empty result. Only vec_id, label and embedding are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm import vectors
from postloom.llm.common import settled
from postloom.llm.va_file import EXACT, integers

#: Components of one block of rows and of one block of anchors.
BLOCK_VALUES, ANCHOR_VALUES = 1 << 20, 1 << 16
#: Bit planes of a turned anchor.
PLANES = 7
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
_SEED = 7
#: Rounding of the double arithmetic behind an interval, as a share of the lengths involved.
_SLACK = 1e-9

BLOCK = "dim int, part bigint, labels binary, ids array<array<bigint>>, kind string, points binary, codes binary, alignment binary, rest binary, means binary, mean_of binary"
POSITIVE = "anchor_id bigint, positive_id bigint, score bigint"
NEGATIVE = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
_LARGEST = 2**63 - 1


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed_bits(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last one padded with zeros."""
    rows, dim = on.shape
    padded = np.zeros((rows, -(-dim // 64) * 64), dtype=bool)
    padded[:, :dim] = on
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def encoded(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and rests of the rows."""
    turned = residuals @ rotation(residuals.shape[1]).T
    alignment = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    rest = np.sqrt(np.maximum((turned**2).sum(axis=1) - alignment**2, 0))
    return packed_bits(turned > 0), alignment, rest


class Anchor:
    """A turned anchor as bit planes."""

    def __init__(self, point: np.ndarray):
        self.point, self.dim = point, len(point)
        turned = rotation(self.dim) @ point
        self.length = float(np.sqrt(point @ point))
        self.low = float(turned.min())
        self.step = max(float(turned.max() - self.low), 1e-300) / (2**PLANES - 1)
        levels = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = packed_bits((levels >> np.arange(PLANES)[:, None]) & 1 == 1)
        held = self.low + self.step * levels
        self.sum = float(held.sum())
        self.error = float(np.abs(turned - held).sum()) / np.sqrt(self.dim)

    def along(self, codes: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Inner product of the planes' values with every code vector, from popcounts.

        `codes` has one row for each 64 components; `on` is the number of ones of each code.
        """
        levels = np.zeros(codes.shape[1], dtype=np.int32)
        for k, plane in enumerate(self.planes):
            for word, bits in zip(codes, plane, strict=True):
                levels += np.bitwise_count(word & bits).astype(np.int32) << k
        return (2 * (self.low * on + self.step * levels) - self.sum) / np.sqrt(self.dim)


class Block:
    """A stored block, opened once for all anchors that meet it."""

    def __init__(self, row):
        self.labels = np.frombuffer(row.labels, dtype="<i8")
        self.ids = row.ids
        self.row_of = {int(i[0]): r for r, i in enumerate(self.ids) if len(i) == 1}
        points = np.frombuffer(row.points, dtype=row.kind).reshape(len(self.ids), -1)
        self.points = points if row.kind != "<f8" else integers(points)
        n = len(self.ids)
        self.coded(np.frombuffer(row.codes, dtype="<u8").reshape(n, -1), np.frombuffer(row.alignment), np.frombuffer(row.rest))
        self.means = np.frombuffer(row.means).reshape(-1, points.shape[1]) if row.means else np.zeros((0, points.shape[1]))
        self.mean_of = np.frombuffer(row.mean_of, dtype="<i4")
        exact = self.points.dtype != object
        self.largest = float(np.abs(self.points).max(initial=0)) if exact else float("inf")
        # Single precision holds whole numbers up to 2**24, and half the bytes.
        self.single = self.points.astype(np.float32) if self.largest**2 * points.shape[1] < 2**24 else None
        self.double = self.points.astype(np.float64) if exact and self.single is None else None

    def coded(self, codes: np.ndarray, alignment: np.ndarray, rest: np.ndarray) -> None:
        self.codes, self.alignment, self.rest = np.ascontiguousarray(codes.T), alignment, rest
        self.on = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)

    def size_with(self, anchor: np.ndarray) -> float:
        """Bound of every partial sum of products with the anchor."""
        return float("inf") if anchor.dtype == object else self.largest * max(float(np.abs(anchor).max(initial=0)), 1.0) * len(anchor)

    def bounds(self, anchor: Anchor, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Certain lower and upper bounds of the rows' inner products with the anchor."""
        alignment, rest = self.alignment[rows], self.rest[rows]
        along = anchor.along(self.codes[:, rows], self.on[rows])
        beside = np.sqrt(np.maximum(anchor.length**2 - np.maximum(np.abs(along) - anchor.error, 0) ** 2, 0))
        middle = (self.means @ anchor.point)[self.mean_of[rows]] + alignment * along
        reach = alignment * anchor.error + rest * beside
        reach += _SLACK * (anchor.length * (alignment + rest) + np.abs(middle)) + 1e-6
        return middle - reach, middle + reach

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of the rows: whole numbers in double precision, or integers of any size."""
        size = self.size_with(anchor)
        if size >= EXACT:
            exact = [int(x) for x in anchor]
            scores = [sum(int(x) * y for x, y in zip(self.points[r], exact, strict=True)) for r in rows]
            return np.array([*scores, None], dtype=object)[:-1]
        if self.single is not None and size < 2**24:
            values, anchor = self.single, anchor.astype(np.float32)
        else:
            values = self.double if self.double is not None else self.single.astype(np.float64)
        if 4 * len(rows) > len(values):  # cheaper than gathering them
            return (values @ anchor)[rows].astype(np.float64)
        return (values[rows] @ anchor).astype(np.float64)

    def best(self, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best ids of the rows but the anchor's own."""
        if len(rows) > k + 1:  # the anchor's own row may be among them
            keep = scores >= np.partition(scores, -k - 1)[-k - 1]
            rows, scores = rows[keep], scores[keep]
        listed = ((-int(s), int(i)) for s, r in zip(scores, rows, strict=True) for i in self.ids[r] if i != own)
        return [(-s, i) for s, i in sorted(listed)[:k]]

    def positives(self, own: int, label: int, point: np.ndarray, k: int) -> list[tuple[int, int]]:
        first, end = (int(x) for x in np.searchsorted(self.labels, [label, label + 1]))
        rows = np.arange(first, end)
        if not len(rows):
            return []
        if self.size_with(point) < EXACT and len(rows) > k + 1:
            least, most = self.bounds(Anchor(point), slice(first, end))
            rows = rows[most >= np.partition(least, -k - 1)[-k - 1]]  # one of the k + 1 may be the anchor's own
        return self.best(rows, self.scores(point, rows), own, k)

    def negatives(self, own: int, label: int, point: np.ndarray, positives: list[tuple[int, int]], k: int) -> list[tuple]:
        """(positive, negative, scores) of the k best rows of other labels within each positive's bounds."""
        limits = [(i, s, -(-LOW * s // 100), HIGH * s // 100) for i, s in positives if s >= 0]
        wanted = np.ones(len(self.labels), dtype=bool)
        wanted[slice(*np.searchsorted(self.labels, [label, label + 1]))] = False
        if own in self.row_of:
            wanted[self.row_of[own]] = False
        if not limits or not wanted.any():
            return []
        if self.size_with(point) < EXACT:
            least, most = self.bounds(Anchor(point), slice(None))
            others, wanted = wanted, np.zeros(len(wanted), dtype=bool)
            for _, _, low, high in limits:
                may = others & (most >= low) & (least <= high)
                sure = least[may & (least >= low) & (most <= high)]
                if len(sure) >= k:
                    may &= most >= np.partition(sure, -k)[-k]
                wanted |= may
        rows = np.flatnonzero(wanted)
        scores = self.scores(point, rows)
        found = []
        for positive, score, low, high in limits:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            best = self.best(rows[inside], scores[inside], own, k)
            found += [(positive, i, _stored(score), _stored(s)) for s, i in best]
        return found


def _stored(score: int) -> int:
    return min(max(score, -_LARGEST - 1), _LARGEST)


def _narrowed(values: np.ndarray, points: np.ndarray) -> tuple[str, bytes]:
    """The whole numbers in the fewest bytes that hold them all, or the original components where none does."""
    if values.dtype != object:
        for kind in ("<i2", "<i4", "<i8"):
            if np.abs(values).max(initial=0) <= np.iinfo(kind).max:
                return kind, values.astype(kind).tobytes()
    return "<f8", points.astype("<f8").tobytes()


def taking_part(df: DataFrame, label: Column) -> DataFrame:
    """vec_id, label (bigint), embedding (doubles) and dim; one row per vec_id."""
    rows = df.select("vec_id", label.cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.whole("embedding"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return one.select("vec_id", "row.*").withColumn("dim", F.size("embedding")).where("dim > 0")


def _parts(values: int, size: int) -> int:
    return max(1, -(-values // size))


def blocks(rows: DataFrame, ids_kept: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """One row per block; a point keeps the `ids_kept` smallest ids of the rows with its label and vector."""
    same = Window.partitionBy("label", "embedding").orderBy("vec_id")
    points = settled(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= ids_kept))
    parts = _parts(points.agg(F.sum("dim").alias("n")).first()["n"] or 0, block_values)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["label", "vec_id"], kind="stable")
        held: dict[tuple[int, bytes], list[int]] = {}
        for label, vector, i in zip(group["label"], group["embedding"], group["vec_id"], strict=True):
            held.setdefault((int(label), (np.asarray(vector) + 0.0).tobytes()), []).append(int(i))
        labels = np.array([label for label, _ in held], dtype=np.int64)
        points = np.stack([np.frombuffer(raw) for _, raw in held])
        values = integers(points)
        kind, stored = _narrowed(values, points)
        means, mean_of = np.zeros((0, 0)), np.zeros(0, dtype=np.int32)
        codes, alignment, rest = np.zeros((len(points), -(-points.shape[1] // 64)), dtype=np.uint64), *np.zeros((2, len(points)))
        if kind != "<f8":
            starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
            sizes = np.diff(np.r_[starts, len(labels)])
            means = np.add.reduceat(values.astype(np.float64), starts, axis=0) / sizes[:, None]
            mean_of = np.repeat(np.arange(len(starts)), sizes).astype(np.int32)
            codes, alignment, rest = encoded(values - means[mean_of])
        blobs = [stored, codes.tobytes(), alignment.tobytes(), rest.tobytes(), means.tobytes(), mean_of.tobytes()]
        row = [group["dim"].iloc[0], group["part"].iloc[0], labels.tobytes(), list(held.values()), kind, *blobs]
        return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

    placed = points.withColumn("part", F.pmod(F.xxhash64("embedding"), F.lit(parts)))
    return settled(placed.groupBy("dim", "part").applyInPandas(build, BLOCK)).withColumn("parts", F.lit(parts))


def _asked(anchors: DataFrame, parts: int, extra: list[str], anchor_values: int = ANCHOR_VALUES) -> DataFrame:
    """Blocks of anchors, each once for every block of rows of their dimension."""
    count = _parts(anchors.agg(F.sum("dim").alias("n")).first()["n"] or 0, anchor_values)
    entry = F.struct("vec_id", "label", "embedding", *extra)
    packed = (
        anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
        .groupBy("dim", "block")
        .agg(F.collect_list(entry).alias("anchors"))
    )
    return packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).drop("block")


def _met(stored: DataFrame, asked: DataFrame, find, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block, found = Block(row), []
                for anchor in row.anchors:
                    point = integers(np.asarray(anchor["embedding"], dtype=np.float64)[None, :])[0]
                    found += find(block, anchor, point)
                yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return stored.join(asked, ["dim", "part"]).mapInPandas(run, schema)


def positives_of(stored: DataFrame, anchors: DataFrame, parts: int, k: int) -> DataFrame:
    """anchor_id, positive_id, score: the k best other rows of every anchor's label."""

    def find(block: Block, anchor, point: np.ndarray) -> list[tuple]:
        own = anchor["vec_id"]
        return [(own, i, _stored(s)) for s, i in block.positives(own, anchor["label"], point, k)]

    found = _met(stored, _asked(anchors, parts, []), find, POSITIVE)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def mined(df: DataFrame, label: Column, every: int, positives: int, negatives: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are every so-many-th id."""
    rows = settled(taking_part(df, label))
    stored = blocks(rows, max(positives + 1, negatives))
    first = stored.select("parts").first()
    parts = first["parts"] if first else 1
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = positives_of(stored, anchors, parts, positives)
    told = found.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))
    told = settled(anchors.join(told, anchors["vec_id"] == told["anchor_id"]).drop("anchor_id"))

    def find(block: Block, anchor, point: np.ndarray) -> list[tuple]:
        own = anchor["vec_id"]
        pairs = [(p["positive_id"], p["score"]) for p in anchor["positives"]]
        return [(own, *row) for row in block.negatives(own, anchor["label"], point, pairs, negatives)]

    hard = _met(stored, _asked(told, parts, ["positives"]), find, NEGATIVE)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
