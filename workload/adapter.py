"""Postings made from the driver's order tables.

The same SQL text builds the frame in Spark and the CTE in the checking engine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators.paging import with_order_columns
from postloom.sources.buckets import BucketedPostings
from postloom.sources.tables import Warehouse

_TABLES = ["orders", "customer", "nation", "part"]

# Every order is one posting; the arithmetic on keys plants blanks, nulls and unparsable text.
POSTINGS = """
SELECT CAST(o.o_orderkey AS STRING) AS raw_id,
       'run-' || CAST(year(o.o_orderdate) AS STRING) AS run_id,
       c.c_mktsegment AS keyword,
       lower(c.c_mktsegment) AS scope_code,
       lower(c.c_mktsegment) AS scope_id,
       n.n_name || ',' || c.c_mktsegment AS city_list,
       CAST(n.n_nationkey AS STRING) AS city_code_list,
       n.n_name AS city,
       CAST(o.o_custkey AS STRING) || '-' || CAST(month(o.o_orderdate) AS STRING) AS job_uid,
       p.p_type || ' ' || p.p_name AS job_name,
       CASE WHEN o.o_orderkey % 13 = 0 THEN '面议' WHEN o.o_orderkey % 11 = 0 THEN ''
            ELSE CAST(CAST(floor(o.o_totalprice / 10000) AS BIGINT) AS STRING) || '万' END AS salary_low,
       CASE WHEN o.o_orderkey % 13 = 0 THEN '面议' WHEN o.o_orderkey % 7 = 0 THEN ''
            ELSE CAST(CAST(floor(o.o_totalprice / 10000) AS BIGINT) + o.o_orderkey % 7 AS STRING) || '万'
       END AS salary_high,
       n.n_name || '-' || CAST(c.c_custkey AS STRING) AS address,
       o.o_orderpriority AS experience,
       o.o_orderstatus AS education,
       CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE p.p_brand END AS job_type,
       CAST(NULL AS STRING) AS work_mode,
       p.p_type AS category,
       c.c_name AS company,
       CASE WHEN p.p_size <= 10 THEN '20人以下' WHEN p.p_size <= 30 THEN '20-99人' ELSE '100人以上' END
           AS company_size,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE p.p_type END AS company_type,
       CASE WHEN o.o_orderkey % 19 = 0 THEN '' ELSE p.p_brand END AS financing,
       p.p_name AS industry,
       CASE WHEN o.o_orderkey % 23 = 0 THEN '未知'
            ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) || ' 10:00:00' END AS publish_time,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderstatus END AS recruiter_status,
       o.o_orderpriority AS recruiter_activity,
       replace(p.p_name, ' ', ' | ') || ' || ' || p.p_type AS skills,
       '<p>' || p.p_name || '</p><br/>' || p.p_type || ' &amp; ' || c.c_name AS description,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) || ' 00:00:00' AS created_at,
       n.n_nationkey AS nation_key
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN {part} p ON p.p_partkey = o.o_custkey
"""

_DIRTY = {
    "raw_id": "CASE WHEN CAST(raw_id AS BIGINT) % 37 = 0 THEN 'x' || raw_id ELSE raw_id END",
    "keyword": "CASE WHEN CAST(raw_id AS BIGINT) % 41 = 0 THEN NULL"
    " WHEN CAST(raw_id AS BIGINT) % 43 = 0 THEN '  ' || keyword || ' '"
    " WHEN CAST(raw_id AS BIGINT) % 47 = 0 THEN 'other' ELSE keyword END",
    "scope_code": "CASE WHEN CAST(raw_id AS BIGINT) % 53 = 0 THEN 'other' ELSE scope_code END",
    "job_uid": "CASE WHEN CAST(raw_id AS BIGINT) % 29 = 0 THEN '  '"
    " WHEN CAST(raw_id AS BIGINT) % 31 = 0 THEN NULL ELSE job_uid END",
}

# The same postings as a crawler might deliver them: bad ids, keywords, codes and uids.
RAW = "SELECT * REPLACE ({}) FROM postings".format(", ".join(f"{e} AS {c}" for c, e in _DIRTY.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTINGS, **{t: table(spark, sf_dir, t) for t in _TABLES})


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = postings(spark, sf_dir)
    return clean.selectExpr(*[f"{_DIRTY[c]} AS {c}" if c in _DIRTY else c for c in clean.columns])


def serving_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings as rows of the serving table."""
    made = with_order_columns(postings(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")))
    return made.select(*S.SERVING.names)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's checkpoint folder; a local one only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="postloom-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def new_store(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, new_folder(spark, "warehouse"))


def new_buckets(spark: SparkSession, name: str) -> BucketedPostings:
    return BucketedPostings(spark, f"{name}_{uuid.uuid4().hex}", new_folder(spark, "buckets"), buckets=16)


def cte() -> str:
    """`WITH` clause for the checking engine: postings and raw."""
    body = POSTINGS.format(**{t: t for t in _TABLES})
    return f"WITH postings AS ({body}),\nraw AS ({RAW})"
