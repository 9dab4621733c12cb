"""Partitioned warehouse tables, JDBC tables and catalog names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import schema as S

SCHEMAS = {
    "snapshot_raw": S.SNAPSHOT,
    "posting_detail": S.DETAIL,
    "posting_skill": S.SKILL,
    "posting_serving": S.SERVING,
    "clean_company": S.CLEAN_COMPANY,
    "clean_recruiter": S.CLEAN_RECRUITER,
    "posting_search": S.POSTING_SEARCH,
    "keyword_index": S.KEYWORD_INDEX,
    "statistic": S.STATISTIC,
    "statistic_hot": S.STATISTIC,
    "statistic_count": S.STATISTIC_COUNT,
    "statistic_delta": S.STATISTIC_COUNT,
    "statistic_merged": S.STATISTIC_COUNT,
    "run_log": S.RUN_LOG,
}
PARTITIONS = {"statistic": ["scope_id", "stat_type"], "statistic_hot": ["scope_id", "stat_type"]}


class Warehouse:
    """Columnar tables under one shared base path, partitioned by scope."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "orc"):
        self.spark = spark
        self.base = base.rstrip("/")
        self.fmt = fmt

    def path(self, table: str, staged: bool = False) -> str:
        """Folder of a table, or of its staging copy beside the tables."""
        return f"{self.base}/{'_staging/' * staged}{table}"

    def read(self, table: str, scope: S.Scope | None = None, staged: bool = False) -> DataFrame:
        """Whole table, or one scope's partition."""
        df = self.spark.read.schema(SCHEMAS[table]).format(self.fmt).load(self.path(table, staged))
        return df if scope is None else df.filter(F.col("scope_id") == scope.scope_id)

    def exists(self, table: str) -> bool:
        """Whether the table has been written."""
        try:
            self.spark.read.format(self.fmt).load(self.path(table))
        except AnalysisException:
            return False
        return True

    def statistics(self, scope: S.Scope, stat_types=S.STAT_TYPES, table: str = "statistic") -> DataFrame:
        return self.read(table, scope).filter(F.col("stat_type").isin(list(stat_types)))

    def posting_source(self, scope: S.Scope, source: str = "warehouse") -> DataFrame:
        """Statistics input: typed warehouse detail, or the serving table's text columns."""
        tables = {"warehouse": "posting_detail", "serving": "posting_serving"}
        if source not in tables:
            raise ValueError(f"unknown source {source!r}")
        return self.read(tables[source], scope)

    def replace(self, table: str, df: DataFrame, scope: S.Scope | None = None, staged: bool = False) -> None:
        """Swap in the partitions present in `df` when the write commits.

        A failed write leaves the old partitions. With `scope` given, `df` holds that scope only:
        it is written without a shuffle, and an empty result empties the partition, which a
        dynamic overwrite would leave as it was. Otherwise rows are first rebalanced, so that a
        task does not open a file per scope; AQE splits a hot scope into evenly sized files.
        """
        keys = PARTITIONS.get(table, ["scope_id"])
        seen = Observation()
        rows = df.select(*SCHEMAS[table].names).observe(seen, F.count(F.lit(1)).alias("rows"))
        if scope is None:
            rows = rows.hint("rebalance", *keys)
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .format(self.fmt)
            .save(self.path(table, staged))
        )
        # Tasks that ran twice may count twice, so the metric only tells none from some.
        if scope is not None and seen.get["rows"] == 0:
            self._empty(table, scope, staged)

    def rewrite(self, table: str, df: DataFrame) -> None:
        """Replaces the whole table, also the partitions that `df` does not hold."""
        writer = df.select(*SCHEMAS[table].names).write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy(*PARTITIONS.get(table, ["scope_id"])).format(self.fmt).save(self.path(table))

    def _empty(self, table: str, scope: S.Scope, staged: bool) -> None:
        fields = [f for f in SCHEMAS[table].fields if f.name != "scope_id"]
        nothing = self.spark.createDataFrame([], T.StructType(fields))
        nothing.write.mode("overwrite").format(self.fmt).save(f"{self.path(table, staged)}/scope_id={scope.scope_id}")

    def count(self, table: str, scope: S.Scope) -> int:
        return self.read(table, scope).count()

    def log_run(self, scope: S.Scope, stage: str, status: str, rows_in: int, rows_out: int, at: str) -> None:
        values = (scope.scope_id, stage, status, rows_in, rows_out, at)
        row = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(S.RUN_LOG.fields, values)]
        (
            self.spark.range(0, 1, 1, 1)
            .select(*row)
            .write.mode("append")
            .partitionBy("scope_id")
            .format(self.fmt)
            .save(self.path("run_log"))
        )

    def register(self, scope: S.Scope) -> list[str]:
        """Temp views of one scope's layers, named `<table>_<scope>`."""
        names = []
        for table in ("snapshot_raw", "posting_detail", "posting_skill"):
            name = f"{table}_{scope.scope_id}"
            self.read(table, scope).createOrReplaceTempView(name)
            names.append(name)
        return names


def bootstrap(spark: SparkSession, database: str, location: str) -> DataFrame:
    """Create the namespace when it is missing and list its tables; drops nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    return spark.sql(f"SHOW TABLES IN `{database}`")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Serving or raw table over JDBC, read in ranges of its numeric key; filters are pushed down."""
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )
