"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id sorts before every other id inside an operator.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the session's `spark.checkpoint.dir`; a local one only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="postloom-checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the cluster's checkpoint folder, so that later steps read files and not the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def id_crc(column: str):
    """CRC-32 of the id's decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def pieces(texts: Iterable[str | None], size: int) -> Iterator[tuple[int, str]]:
    """(index of the text, part of it) with parts of at most `size` characters; null counts as empty."""
    for index, text in enumerate(texts):
        text = text or ""
        for at in range(0, len(text), size):
            yield index, text[at : at + size]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half the bits of the result."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(31)
    return values
