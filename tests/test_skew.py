"""Hot keys: results stay whole, and no task or broadcast grows with the hot group."""

from pyspark.sql import functions as F

from postloom.operators.assembly import assemble
from postloom.operators.dedup import latest, latest_postings
from postloom.operators.lookup import hot_keys, left_lookup
from postloom.operators.packing import pack
from postloom.operators.skills import explode_skills
from postloom.operators.typing import typed
from postloom.plans import statistics as stats


def facts(spark, n=3000):
    """A third of the rows on one key, a tenth without one."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    return spark.range(n).select("id", key.alias("k"))


def test_hot_keys_are_found_and_bounded(spark):
    got = hot_keys(facts(spark), "k", share=100)
    assert [r.k for r in got.collect()] == ["hot"]
    even = spark.range(1000).select((F.col("id") % 50).cast("string").alias("k"))
    assert hot_keys(even, "k", share=50).count() == 0
    assert hot_keys(even, "k", share=51).count() == 50


def test_lookup_keeps_every_row(spark):
    rows = facts(spark)
    dimension = spark.range(0, 700, 2).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    dimension = dimension.unionByName(spark.createDataFrame([("hot", -1), ("lonely", -2)], "k string, v long"))
    got = left_lookup(rows, dimension, "k", share=100)
    plain = rows.join(dimension, "k", "left").select("id", "k", "v")
    assert got.columns == ["id", "k", "v"]
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_lookup_spreads_the_hot_key(spark):
    rows = facts(spark)
    versions = spark.range(1400).select(
        F.concat(F.lit("k"), F.col("id") % 700).alias("k"), F.col("id").alias("v"), F.col("id").alias("raw_id")
    )
    versions = versions.unionByName(spark.createDataFrame([("hot", 1, 1)], "k string, v long, raw_id long"))
    dimension = latest(versions, ["k"], F.col("raw_id")).drop("raw_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = left_lookup(rows, dimension, "k", share=100)
        assert "hashpartitioning(k" in got._jdf.queryExecution().executedPlan().toString()
        per_task = got.groupBy(F.spark_partition_id()).count().collect()
        plain = rows.join(dimension, "k", "left").select("id", "k", "v")
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in per_task) == 3000
    assert max(r["count"] for r in per_task) < 1000


def test_parts_of_a_large_statistic_go_to_different_tasks(spark):
    rows = spark.range(4000).select(
        F.lit("s").alias("scope_id"),
        F.lit("city").alias("stat_type"),
        F.col("id").cast("string").alias("category"),
        F.lit(1).cast("long").alias("value"),
        F.lit(None).cast("double").alias("average_salary_wan"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packed = pack(rows, "t", part_size=100)
        tasks = packed.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in tasks) == 40
    assert len(tasks) > 1


def test_hot_uid_is_pruned_before_the_shuffle(snapshot):
    rows = snapshot(*[{"raw_id": str(i)} for i in range(500)], {"raw_id": "1", "job_uid": "u2"})
    newest = latest_postings(rows.repartition(4))
    assert sorted(r.raw_id for r in newest.collect()) == ["1", "499"]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    last = plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[last : last + 400] and "Exchange" in plan[:last]


def test_hot_category_is_folded_before_the_shuffle(snapshot):
    plan = stats.category_counts(typed(snapshot({})))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1


def test_assembly(spark):
    posting = spark.createDataFrame(
        [("1", "acme", 7), ("2", "acme", 8), ("3", "solo", None), ("4", None, 7)],
        "raw_id string, company string, recruiter_id int",
    )
    company = spark.createDataFrame(
        [("1", "acme", "small"), ("10", "acme", "big"), ("2", "unused", "x")],
        "raw_id string, company string, company_size string",
    )
    recruiter = spark.createDataFrame([("1", 7, "on")], "raw_id string, recruiter_id int, recruiter_status string")
    got = assemble(posting, company, recruiter).orderBy("raw_id").collect()
    assert [(r.raw_id, r.company_size, r.recruiter_status) for r in got] == [
        ("1", "big", "on"),
        ("2", "big", None),
        ("3", None, None),
        ("4", None, "on"),
    ]


def test_building_statistics_runs_no_job(spark, snapshot):
    detail = typed(snapshot({}))
    spark.sparkContext.setJobGroup("building", "building")
    try:
        stats.statistics(detail, explode_skills(detail), "t")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_hot_key_without_a_dimension_row_is_spread(spark):
    """A placeholder id that a third of the facts hold, unknown to the dimension."""
    facts = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    dimension = spark.range(9000).select(F.col("id").alias("k"), F.col("id").alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left_lookup(facts, dimension, "k", share=20)
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert joined.filter("k = -1 AND w IS NOT NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(tasks) == 9000 and max(tasks) < 2 * 9000 / len(tasks)
