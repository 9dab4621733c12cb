"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

A document is its token ids and one closing id. Documents longer than the capacity are cut into pieces of exactly
the capacity, except that the first piece takes the remainder. The plan is best-fit decreasing over (length, count)
pairs: at most `capacity` histogram rows reach the driver, however many documents there are. Pieces then take the
planned slots by joining on their rank within their length.

Null texts count as empty (one closing id). Rows that repeat are packed as often as they occur. An empty table
gives an empty result. Clashing column names cannot occur, as only `doc_id` and `text` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.byte_bpe import BytePairs
from postloom.llm.common import settled

CAPACITY = 2048
CLOSING_ID = 0
#: Parts that pieces of one length are ranked in, so that a length that many share is no single group.
RANK_PARTS = 1024

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("length", "first_rank", "count", "per_bin", "first_bin", "base")]
)


# Fixed value: the pattern by which byte-level vocabularies cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the added token of these vocabularies, which the rank form does not hold.
ADDED = "<|endoftext|>", 50256
#: Runs of one kind of character from this length on overflow the stack of tiktoken's pattern matcher.
LONG_RUN = re.compile(r"\s{20000}|\S{20000}")

_encoders: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, none added before or after, kept as long as the Python worker.

    The ids are those of `encode(text, add_special_tokens=False)` of the tokenizers library, which takes the string of
    an added token in a text as that token (`ADDED`). A .json file is read by that library, a .tiktoken file of ranks
    by tiktoken; where both hold the same vocabulary the ids are the same, and the second is about six times as fast.
    """
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import tiktoken

            pairs = BytePairs.read(path, PATTERN)
            made = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
            fast = made.encode_ordinary

            def between(text: str) -> list[int]:
                return fast(text) if not LONG_RUN.search(text) else pairs.encode(text)

            def encode(text: str) -> list[int]:
                name, number = ADDED
                if name not in text:
                    return between(text)
                first, *rest = text.split(name)
                return between(first) + [i for part in rest for i in (number, *between(part))]

            _encoders[path] = encode
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _encoders[path] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def cut(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian 32-bit ids)."""
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array(encode(text or ""), dtype="<u4").tobytes() + closing
                n = len(ids) // 4
                ends = list(range(n, 0, -capacity))[::-1]
                starts = [0, *ends[:-1]]
                for piece, (start, end) in enumerate(zip(starts, ends, strict=True)):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return df.select("doc_id", "text").mapInPandas(run, PIECES)


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first_rank, count, per_bin, first_bin, base): the pieces of that length with ranks from
    first_rank fill bins from first_bin, per_bin to a bin, the first of a bin at place `base`.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first bin, bins)
    runs, bins = [], 0

    def place(length: int, rank: int, left: int, room: int, first: int, count: int) -> int:
        """Puts pieces into bins of one run and returns how many pieces it took."""
        fit = room // length
        full, rest = divmod(min(left, fit * count), fit)
        base = capacity - room
        if full:
            runs.append((length, rank, full * fit, fit, first, base))
            free.setdefault(room - fit * length, []).append((first, full))
        if rest:
            runs.append((length, rank + full * fit, rest, rest, first + full, base))
            free.setdefault(room - rest * length, []).append((first + full, 1))
        if (used := full + (rest > 0)) < count:
            free.setdefault(room, []).append((first + used, count - used))
        return full * fit + rest

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            room = min((r for r, runs_of in free.items() if r >= length and runs_of), default=None)
            if room is None:
                fresh = -(-(count - rank) // (capacity // length))
                free.setdefault(capacity, []).append((bins, fresh))
                bins, room = bins + fresh, capacity
            first, many = free[room].pop()
            rank += place(length, rank, count - rank, room, first, many)
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; their other columns stay."""
    pieces = settled(cut_pieces)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS))
    parted = pieces.select(*columns, part.alias("__part"))
    counts = settled(parted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__count")))
    histogram = [tuple(r) for r in counts.groupBy("length").agg(F.sum("__count")).collect()]  # at most `capacity` rows
    planned = pieces.sparkSession.createDataFrame(plan(histogram, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__part", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        parted.withColumn("__inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "__part"])
        .withColumn("__rank", F.col("__before") + F.col("__inside"))
    )
    # The plan has a few rows per length at most, as each length opens or ends a few runs of bins.
    slots = F.broadcast(planned.withColumnRenamed("length", "__length"))
    at = F.col("__rank") - F.col("first_rank")
    return ranked.join(
        slots, (F.col("length") == F.col("__length")) & (at >= 0) & (at < F.col("count"))
    ).select(
        *columns,
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
