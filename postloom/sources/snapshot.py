"""CSV snapshots: 28 text columns, header line, `"` quotes, `\\` escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.sources import csv_ranges

_DIALECT = {"sep": ",", "quote": '"', "escape": "\\", "header": "true", "emptyValue": ""}
ROWS_PER_FILE = 500_000


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read a snapshot as text columns; nothing is inferred.

    With `multi_line` a quoted line break stays inside its field, and large files are still read by many tasks. Pass
    False for files that hold no quoted line breaks: Spark then reads them once instead of twice.
    """
    if multi_line:
        return csv_ranges.read(spark, path, S.SNAPSHOT, _DIALECT)
    return spark.read.schema(S.SNAPSHOT).options(**_DIALECT).option("enforceSchema", "true").csv(path)


def write_snapshot(df: DataFrame, root: str, scope: S.Scope, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Replace one scope's snapshot when the write commits; returns its path."""
    names = {new: old for old, new in S.SNAPSHOT_COLUMNS.items()}
    (
        df.filter(F.col("scope_id") == scope.scope_id)
        .select(*[F.col(n).alias(names[n]) for n in S.SNAPSHOT.names], F.lit(scope.scope_id).alias("scope"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .options(**_DIALECT, quoteAll="true")
        .partitionBy("scope")
        .csv(root)
    )
    return f"{root.rstrip('/')}/scope={scope.scope_id}"
