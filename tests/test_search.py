import pytest
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import text as X
from postloom.operators import filters, paging
from postloom.operators.counts import default_scope, scope_catalog
from postloom.operators.facets import facet_values, ordered_facets
from postloom.plans import display
from postloom.plans.search import list_jobs

SCOPE = "shuju_fenxi"


def ids(df, name="raw_id"):
    return sorted(r[0] for r in df.select(name).collect())


def hits(df, **query):
    return ids(df.filter(filters.JobQuery(SCOPE, **query).predicate()))


def test_scope_is_always_filtered(snapshot):
    rows = snapshot({"raw_id": "1"}, {"raw_id": "2", "scope_id": "other"})
    assert hits(rows) == ["1"]
    with pytest.raises(ValueError):
        filters.JobQuery("")


def test_facets_combine_and_blank_means_none(snapshot):
    rows = snapshot(
        {"raw_id": "1", "city": "北京", "education": "本科"},
        {"raw_id": "2", "city": "北京", "education": None},
        {"raw_id": "3", "city": "上海", "education": "本科"},
    )
    assert hits(rows, city="北京") == ["1", "2"]
    assert hits(rows, city=" 北京 ", education="本科") == ["1"]
    assert hits(rows, city="  ") == ["1", "2", "3"]


def test_keyword_searches_four_columns(snapshot):
    blank = {"job_name": "x", "company": "x", "skills": "x", "description": None}
    rows = snapshot(
        *[{**blank, "raw_id": str(i), c: "a SQL b"} for i, c in enumerate(S.SEARCH_COLUMNS)],
        {**blank, "raw_id": "9", "city": "SQL"},
    )
    assert hits(rows, keyword="sql") == ["0", "1", "2", "3"]


@pytest.mark.parametrize(
    "keyword, found",
    [("%", ["1", "2", "3"]), ("s_l", ["1"]), (r"100\%", ["2"]), ("\\", []), (r"s\ql", ["1"])],
)
def test_keyword_wildcards(snapshot, keyword, found):
    nothing = {"company": None, "skills": None, "description": None}
    rows = snapshot(
        {**nothing, "raw_id": "1", "job_name": "sql"},
        {**nothing, "raw_id": "2", "job_name": "100% remote"},
        {**nothing, "raw_id": "3", "job_name": "1000"},
        {**nothing, "raw_id": "4", "job_name": None},
    )
    assert hits(rows, keyword=keyword) == found


@pytest.mark.parametrize(
    "low, high, query, found",
    [
        ("10万", "20万", {"salary_min": 20.0}, True),
        ("10万", "20万", {"salary_min": 21.0}, False),
        ("10万", "20万", {"salary_max": 10.0}, True),
        ("10万", "20万", {"salary_max": 9.0}, False),
        (None, None, {"salary_min": 0.0}, False),
        ("", "", {"salary_max": 99.0}, False),
        ("面议", "面议", {"salary_max": 99.0}, False),
        ("12.35", "12.35", {"salary_min": 12.35}, True),
        ("12.35", "12.35", {"salary_min": 12.351}, False),
        ("12.35", "12.35", {"salary_max": 12.349}, False),
        ("12.35", "12.35", {"salary_max": 12.359}, True),
        ("10", "20", {}, True),
        ("10", "20", {"salary_min": -5.0, "salary_max": 1e12}, True),
    ],
)
def test_salary_overlap(snapshot, low, high, query, found):
    rows = snapshot({"salary_low": low, "salary_high": high})
    assert bool(hits(rows, **query)) is found


def test_typed_salary_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT CAST(1 AS DECIMAL(10,2)) AS lo, CAST(2 AS DECIMAL(10,2)) AS hi").write.parquet(path)
    wanted = filters.overlaps_salary(F.col("lo"), F.col("hi"), 1.5, 3.0)
    plan = spark.read.parquet(path).filter(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hi,1.50)" in plan and "LessThanOrEqual(lo,3.00)" in plan


def _many(spark, n, days=7, none_every=11):
    return spark.range(n).select(
        F.col("id").cast("string").alias("raw_id"),
        F.when(F.col("id") % none_every == 0, None)
        .otherwise(
            F.concat(
                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int")).cast("string"),
                F.lit(" 10:"),
                F.lpad((F.col("id") % 60).cast("string"), 2, "0"),
                F.lit(":30.25"),
            )
        )
        .alias("publish_time"),
    )


def _expected(df):
    rows = df.collect()
    return [r.raw_id for r in sorted(rows, key=lambda r: (r.publish_time or "", int(r.raw_id)), reverse=True)]


@pytest.mark.parametrize("day_rows", [1, 50, 10_000])
@pytest.mark.parametrize("days", [1, 7, 365])
def test_every_page_depth_agrees(spark, day_rows, days):
    df = _many(spark, 600, days).cache()
    expected = _expected(df)
    for number in (1, 17, 58, 60, 61):
        got = [r.raw_id for r in paging.page(df, number, 11, day_rows).collect()]
        assert got == expected[(number - 1) * 11 : number * 11]


def test_pages_cover_everything_once(spark):
    df = _many(spark, 95)
    expected = _expected(df)
    for day_rows in (10**6, 5):
        pages = [paging.page(df, n, 30, day_rows).collect() for n in range(1, 5)]
        assert [r.raw_id for rows in pages for r in rows] == expected


def test_page_of_equal_and_unreadable_keys(spark):
    same = spark.range(40).select(F.lit("7").alias("raw_id"), F.lit("2024-01-01").alias("publish_time"))
    assert [paging.page(same, n, 15, 5).count() for n in (1, 2, 3, 4)] == [15, 15, 10, 0]
    odd = spark.createDataFrame([("x", "2024-01-01"), ("5", None), ("6", "1969-05-05 03:00:00"), ("-3", None), (None, "?")],
                                "raw_id string, publish_time string")
    for day_rows in (1, 100):
        got = [r.raw_id for n in (1, 2, 3) for r in paging.page(odd, n, 2, day_rows).collect()]
        assert got == ["x", "6", "5", "-3", None]


def test_deep_page_takes_three_jobs_and_pushes_its_bounds(spark, tmp_path):
    path = str(tmp_path / "postings")
    paging.with_order_columns(_many(spark, 600, 365)).write.orc(path)
    stored = spark.read.orc(path)
    spark.sparkContext.setJobGroup("page", "page")
    try:
        found = paging.page(stored, 31, 10, day_rows=1)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(published_at" in pushed and "LessThan(publi" in pushed
    assert "TakeOrderedAndProject" in plan
    # With adaptive planning each of the two counts runs as a map and a result job.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("page")) <= 4


@pytest.mark.parametrize("total, pages", [(0, 1), (10, 1), (11, 2), (20, 2)])
def test_page_meta(spark, total, pages):
    row = paging.page_meta(spark.range(total), 1, 10).first()
    assert (row.total, row.pages, row.page, row.page_size) == (total, pages, 1, 10)


@pytest.mark.parametrize("page, size", [(0, 10), (1, 0), (1, 51), (1_000_001, 10)])
def test_page_bounds(page, size):
    with pytest.raises(ValueError):
        filters.JobQuery(SCOPE, page=page, page_size=size)


def test_list_jobs(snapshot):
    rows = snapshot(*[{"raw_id": str(i), "job_uid": f"u{i}"} for i in range(12)], {"scope_id": "other"})
    items, meta = list_jobs(rows, filters.JobQuery(SCOPE, page=2))
    assert items.columns == list(S.LIST_FIELDS.values())
    assert [r.job_id for r in items.collect()] == ["u1", "u0"]
    assert meta.first().asDict() == {"total": 12, "page": 2, "page_size": 10, "pages": 2}


def test_job_detail(snapshot):
    rows = snapshot(
        {"raw_id": "9", "description": "old"},
        {"raw_id": "10", "scope_id": "other", "description": "<p>new</p>&amp;"},
    )
    newest = filters.job_detail(rows, "u1").first()
    assert newest.asDict().keys() == set(S.DETAIL_FIELDS.values())
    assert newest.description == "new\n&"
    assert filters.job_detail(rows, "u1", SCOPE).first().description == "old"
    assert filters.job_detail(rows, "absent").isEmpty()


def test_recent(snapshot):
    rows = snapshot(
        *[{"raw_id": str(i)} for i in range(8)],
        {"raw_id": "100", "publish_time": "abc"},
        {"raw_id": "1", "scope_id": "other"},
    )
    got = paging.recent(rows, 5).groupBy("scope_id").agg(F.array_sort(F.collect_list("raw_id")).alias("ids"))
    assert {r.scope_id: r.ids for r in got.collect()} == {SCOPE: ["3", "4", "5", "6", "7"], "other": ["1"]}


def test_facet_values(snapshot):
    rows = snapshot(
        {"city": "b", "education": None, "experience": " ", "industry": "i"},
        {"city": "a", "education": "", "experience": "1", "industry": "i"},
        {"city": "z", "scope_id": "other"},
    )
    assert [(r.facet, r.value) for r in ordered_facets(rows, SCOPE).collect()] == [
        ("cities", "a"),
        ("cities", "b"),
        ("experiences", "1"),
        ("industries", "i"),
    ]
    plan = facet_values(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_scope_catalog(snapshot):
    rows = snapshot(
        {"scope_id": "a", "keyword": "k1", "city_list": "x"},
        {"scope_id": "a", "keyword": "k2", "city_list": "y"},
        {"scope_id": "b", "keyword": "k3"},
    ).withColumn("created_at", F.when(F.col("scope_id") == "b", "2024-02-01").otherwise("2024-01-01"))
    got = [tuple(r) for r in scope_catalog(rows).collect()]
    assert got == [("b", "k3", None, 1, "2024-02-01"), ("a", "k2", "y", 2, "2024-01-01")]
    assert default_scope(rows).first().scope_id == "b"


def test_amount_rules_differ_on_inner_markers(snapshot):
    row = snapshot({"salary_low": "1万5"})
    assert row.select(X.wan_amount(F.col("salary_low"))).first()[0] is None
    assert row.select(X.wan_amount_anywhere(F.col("salary_low"))).first()[0] == 15


def test_display(snapshot):
    rows = snapshot({"education": "", "experience": None, "salary_high": None, "address": "", "job_type": " "})
    shown = display.listing(filters.renamed(rows, S.LIST_FIELDS)).first()
    assert (shown.salary, shown.education, shown.experience, shown.company_type) == ("10万–—", "不限", "不限", "未知")
    full = display.detail(filters.job_detail(rows, "u1")).first()
    assert (full.education, full.job_type, full.address, full.industry) == ("学历不限", " ", "北京", "未知")
    assert (full.description, full.skill_tags, full.salary) == ("暂无职位描述", ["sql", "python"], "10万–—")


def test_posting_that_is_not_there(snapshot):
    assert filters.found_detail(snapshot({}), "u1").count() == 1
    with pytest.raises(filters.PostingNotFound):
        filters.found_detail(snapshot({}), "nobody")
