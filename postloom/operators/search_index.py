"""Keyword search over an inverted index of character bigrams, per scope.

The search table holds the postings with a number `doc`, ascending within its files. The index holds, for every
lower-cased bigram and block of `BLOCK` numbers, the sorted places of the postings with that bigram in one of the
searched columns; the file format stores such lists as differences. A frequent bigram is many rows, one a block, so
no list grows with the table.

The lists are made in two steps. Each task turns its postings, some millions of characters at a time, into sorted
arrays of (bigram, place) and hands on one list for each bigram and block; Spark merges the lists of a block. So what
is shuffled are lists, not single pairs, and the characters themselves are paired in numpy.

A pattern's literal runs give its bigrams. The blocks' lists are intersected, rarest first, and the pattern is matched
on the postings that remain only. A pattern without two literal characters in a row is matched on every posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X
from postloom.operators.filters import matches_keyword
from postloom.sources.tables import Warehouse

BLOCK = 1 << 16
#: Up to so many candidates are named in the scan's filter; more are joined.
LISTED = 1_000
#: Bytes of text that a task pairs at once (a posting is never parted), and bits of a code point.
TOGETHER, POINT = 8 << 20, 21
LISTS = "scope_id string, gram string, block bigint, offsets array<int>"


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text is lower-cased already."""
    chars = F.split(text, "")
    pairs = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), pairs), F.slice(chars, F.lit(2), pairs), lambda a, b: F.concat(a, b)))


def build(store: Warehouse, postings: DataFrame) -> None:
    """Replaces the search table and the index of the scopes in `postings`."""
    columns = [n for n in S.POSTING_SEARCH.names if n != "doc"]
    numbered = postings.select(*columns).hint("rebalance", "scope_id").withColumn("doc", F.monotonically_increasing_id())
    _write(store, "posting_search", numbered.sortWithinPartitions("scope_id", "doc"))
    # The numbers are given anew whenever the plan runs, so the index is made from the stored ones.
    scopes = postings.select("scope_id").distinct()
    stored = store.read("posting_search").join(scopes, "scope_id", "left_semi")
    _write(store, "keyword_index", postings_lists(stored).repartitionByRange("scope_id", "gram", "block").sortWithinPartitions("scope_id", "gram", "block"))


def _write(store: Warehouse, table: str, df: DataFrame) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope_id")
    writer.format(store.fmt).save(store.path(table))


def postings_lists(rows: DataFrame) -> DataFrame:
    """(scope_id, gram, block, offsets) of rows with scope_id, doc and the searched columns."""
    block, size = F.floor(F.col("doc") / BLOCK).cast("long"), BLOCK
    place = F.pmod("doc", F.lit(BLOCK)).cast("int")
    # Lower-cased by the engine, as patterns are.
    lowered = [F.lower(c).cast("binary").alias(c) for c in S.SEARCH_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _bounded(batches):
            for (scope_id, block), own in _by_block(part):
                grams, offsets = _paired(own, size)
                yield pd.DataFrame({"scope_id": scope_id, "gram": grams, "block": block, "offsets": offsets})

    parts = rows.select("scope_id", block.alias("block"), place.alias("offset"), *lowered).mapInPandas(run, LISTS)
    merged = F.sort_array(F.flatten(F.collect_list("offsets"))).alias("offsets")
    return parts.groupBy("scope_id", "gram", "block").agg(merged).select("gram", "block", "offsets", "scope_id")


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in parts of about `TOGETHER` bytes of text."""
    held, size = [], 0
    for batch in batches:
        sizes = sum(np.fromiter((len(v) if v else 0 for v in batch[c]), np.int64, len(batch)) for c in S.SEARCH_COLUMNS)
        # A part ends before the row with which its bytes reach the next multiple of the bound.
        at = 0
        for start in np.flatnonzero(np.diff((size + np.cumsum(sizes)) // TOGETHER, prepend=0)):
            yield pd.concat([*held, batch.iloc[at:start]])
            held, at = [], start
        held.append(batch.iloc[at:])
        size = (size + int(sizes.sum())) % TOGETHER
    if held:
        yield pd.concat(held)


def _by_block(rows: pd.DataFrame) -> Iterator[tuple[tuple[str | None, int], pd.DataFrame]]:
    """The rows of each scope and block."""
    scope, scopes = pd.factorize(rows["scope_id"].to_numpy(dtype=object), use_na_sentinel=False)
    block, blocks = pd.factorize(rows["block"].to_numpy())
    group = scope * len(blocks) + block
    order = np.argsort(group, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(own):
            scope_id = scopes[scope[own[0]]]
            yield (None if pd.isna(scope_id) else scope_id, blocks[block[own[0]]]), rows.iloc[own]


def _paired(rows: pd.DataFrame, block: int) -> tuple[list[str], list[np.ndarray]]:
    """The bigrams of the rows' texts, each with its sorted places."""
    cells = [(v.decode("utf-8", "replace"), at) for c in S.SEARCH_COLUMNS for v, at in zip(rows[c], rows["offset"], strict=True) if v]
    if not cells:
        return [], []
    lengths = np.fromiter((len(text) for text, _ in cells), np.int64, len(cells))
    points = np.frombuffer("".join(text for text, _ in cells).encode("utf-32-le"), "<u4").astype(np.int64)
    bits = max(1, (block - 1).bit_length())
    within = np.ones(len(points), bool)
    within[np.cumsum(lengths) - 1] = False  # a text's last character begins no pair
    within = within[:-1]
    owner = np.repeat(np.fromiter((at for _, at in cells), np.int64, len(cells)), lengths)
    pairs = ((points[:-1] << POINT | points[1:]) << bits | owner[:-1])[within]
    pairs.sort()
    if not len(pairs):
        return [], []
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    grams = pairs >> bits
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    places = (pairs & (1 << bits) - 1).astype(np.int32)
    spelled = [chr(g >> POINT) + chr(g & (1 << POINT) - 1) for g in grams[first].tolist()]
    return spelled, np.split(places, first[1:])


def runs(pattern: str) -> list[str]:
    """Literal runs of a LIKE pattern."""
    found, chars = [""], iter(pattern)
    for ch in chars:
        if ch in "%_":
            found.append("")
        else:
            found[-1] += next(chars, "") if ch == "\\" else ch
    return [run for run in found if run]


def needed(spark: SparkSession, keyword: str) -> list[str]:
    """The bigrams that a match must hold, by the same functions that made the index."""
    lowered = spark.range(1).select(F.lower(F.lit(X.like_pattern(keyword)))).first()[0]
    literal = [F.lit(run) for run in runs(lowered)]
    if not literal:
        return []
    return spark.range(1).select(F.array_distinct(F.flatten(F.transform(F.array(*literal), bigrams)))).first()[0]


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """(scope_id, block, doc) of the postings that hold every bigram in some column."""
    lists = index.filter(F.col("gram").isin(grams)).groupBy("scope_id", "block").agg(F.collect_list("offsets").alias("lists"))
    rarest = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
    common = F.aggregate(F.slice(rarest, 2, len(grams)), F.get(rarest, F.lit(0)), lambda held, other: F.array_intersect(held, other))
    complete = lists.filter(F.size("lists") == len(grams)) if len(grams) > 1 else lists
    return complete.select("scope_id", "block", F.explode(common).alias("offset")).select(
        "scope_id", "block", (F.col("block") * BLOCK + F.col("offset")).alias("doc")
    )


def find(store: Warehouse, keyword: str, scope_id: str | None = None, listed: int = LISTED) -> DataFrame:
    """The postings that the keyword matches, as rows of the search table."""
    rows, index = store.read("posting_search"), store.read("keyword_index")
    if scope_id is not None:
        rows, index = (df.filter(F.col("scope_id") == scope_id) for df in (rows, index))
    matched = matches_keyword(keyword)
    if matched is None:
        return rows
    grams = needed(store.spark, keyword)
    if not grams:
        return rows.filter(matched)
    found = candidates(index, grams)
    few = found.limit(listed + 1).collect()
    if len(few) <= listed:
        places = rows.filter(F.col("scope_id").isin(sorted({r.scope_id for r in few})) & F.col("doc").isin(sorted({r.doc for r in few})))
        return places.filter(matched)
    # The condition names both sides, so it is not pushed below the join: the match is tried on candidates only.
    joined = rows.join(found, ["scope_id", "doc"])
    return joined.filter(F.when(F.col("block") >= 0, matched)).drop("block")
