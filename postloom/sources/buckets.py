"""The newest version of every posting in a bucketed table, merged with new snapshots without moving what is stored.

The table is bucketed by job uid. A merge brings the new rows, one a key, to the stored buckets by one shuffle and
joins there; the stored side is read bucket by bucket. The result is written as the next version of the table with the
same buckets, and a view is switched to it, so readers see the old state or the new one. A look-up by uid reads one
bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.dedup import latest_postings
from postloom.operators.filters import has_uid, job_detail

BUCKETS = 64


class BucketedPostings:
    """Versions `<name>_v1`, `<name>_v2`, ... under `folder`, and the view `<name>` of the last one."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS, fmt: str = "orc"):
        self.spark, self.name, self.folder, self.buckets, self.fmt = spark, name, folder.rstrip("/"), buckets, fmt

    def version(self) -> int:
        """Number of the last version, 0 before the first merge."""
        tables = self.spark.sql(f"SHOW TABLES LIKE '{self.name}_v*'").collect()
        return max((int(t.tableName.rsplit("_v", 1)[1]) for t in tables), default=0)

    def read(self) -> DataFrame:
        return self.spark.table(f"{self.name}_v{self.version()}")

    def merged(self, snapshot: DataFrame) -> DataFrame:
        """The newest of the stored and the new version of every posting; ties go to the stored one."""
        fresh = latest_postings(snapshot.filter(has_uid()))
        if not self.version():
            return fresh
        stored = self.read()
        old, new = stored.alias("old"), fresh.select(*stored.columns).alias("new")
        # Buckets are by uid alone. Written as an equality, the scope would become part of the join's key, and Spark
        # would then shuffle both sides by uid and scope.
        same_scope = ~((F.col("old.scope_code") < F.col("new.scope_code")) | (F.col("old.scope_code") > F.col("new.scope_code")))
        both = old.join(new, (F.col("old.job_uid") == F.col("new.job_uid")) & same_scope, "full_outer")
        number = lambda side: F.col(f"{side}.raw_id").try_cast("long")
        newer = F.col("old.job_uid").isNull() | F.coalesce(number("new") > number("old"), F.lit(False))
        return both.select(*[F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in stored.columns])

    def merge(self, snapshot: DataFrame) -> DataFrame:
        """Writes the next version and switches the view to it; the version before the last one is dropped."""
        last = self.version()
        name = f"{self.name}_v{last + 1}"
        writer = self.merged(snapshot).write.bucketBy(self.buckets, "job_uid").sortBy("job_uid").format(self.fmt)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.spark.sql(f"CREATE OR REPLACE VIEW `{self.name}` AS SELECT * FROM `{name}`")
        if last > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}_v{last - 1}`")
        return self.read()

    def detail(self, job_uid: str, scope_id: str | None = None) -> DataFrame:
        """One posting by uid, from one bucket."""
        return job_detail(self.read(), job_uid, scope_id)
