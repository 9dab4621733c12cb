import json

import pytest
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators import geo, packing, ranking
from postloom.operators.skills import explode_skills
from postloom.operators.typing import typed
from postloom.plans import context
from postloom.plans import statistics as stats
from postloom.plans import warehouse as W
from postloom.sources.snapshot import write_snapshot
from postloom.sources.tables import Warehouse

AT = "2024-02-01 00:00:00"


@pytest.fixture
def postings(snapshot):
    """60 postings in two scopes with blanks, unknown salaries and dates."""
    rows = []
    for i in range(60):
        rows.append(
            {
                "raw_id": str(i),
                "job_uid": f"u{i}",
                "scope_id": "b" if i % 3 == 0 else "a",
                "city": ["北京", "上海", "", None, "火星"][i % 5],
                "company": None if i % 10 == 0 else f"c{i % 23}",
                "education": ["本科", " ", S.UNKNOWN][i % 3],
                "experience": str(i % 9),
                "company_size": str(i % 2),
                "company_type": str(i % 12) if i % 4 else None,
                "financing": "A",
                "industry": f"i{i % 17}",
                "salary_low": ["1万", "面议", "49.99", "8"][i % 4],
                "salary_high": ["3万", "9", "50.01", "11.99"][i % 4],
                "publish_time": "bad" if i % 20 == 7 else f"2024-01-{1 + (i * 7) % 31:02d} 10:00:00",
                "skills": f"s{i % 25}|common| |s{i % 3}",
            }
        )
    return snapshot(*rows)


def as_dict(df):
    return {(r.scope_id, r.category): r.value for r in df.collect()}


def test_salary_buckets(snapshot):
    pairs = [("0", "0"), ("4", "5.99"), ("4", "6"), ("29.99", "30"), ("30", "30"), ("50", "50"), ("1", None), ("-3", "1")]
    rows = typed(snapshot(*[{"raw_id": str(i), "salary_low": a, "salary_high": b} for i, (a, b) in enumerate(pairs)]))
    got = rows.orderBy("raw_id").select(stats.salary_bucket()).collect()
    assert [r[0] for r in got] == ["0-5", "0-5", "5-10", "20-30", "30-50", "50+", None, None]


@pytest.mark.parametrize("stat_type", ["city", "education", "experience", "company_size", "company_type", "financing"])
def test_counts_add_up_to_the_jobs(postings, stat_type):
    got = as_dict(stats.distribution(typed(postings), stat_type))
    assert sum(v for (s, _), v in got.items() if s == "a") == 40
    assert sum(v for (s, _), v in got.items() if s == "b") == 20


def test_blank_and_literal_unknown_share_a_row(postings):
    got = as_dict(stats.distribution(typed(postings), "education"))
    assert got == {("b", "本科"): 20, ("a", S.UNKNOWN): 40}


def test_summary_ignores_blanks(snapshot):
    rows = snapshot(
        {"company": "x", "city": "c", "salary_low": "10", "salary_high": "20"},
        {"company": "", "city": None, "salary_low": "面议"},
        {"company": "x", "city": S.UNKNOWN, "salary_low": "1", "salary_high": "2"},
    )
    row = stats.summary(typed(rows)).first()
    assert (row.job_count, row.company_count, row.city_count, row.salary_job_count) == (3, 1, 2, 2)
    assert row.average_annual_salary_wan == (15 + 1.5) / 2


def test_trend_is_thirty_days_zero_filled(snapshot):
    days = ["2024-03-01", "2024-03-01", "2024-02-01", "2024-01-31", "abc"]
    got = as_dict(stats.publish_trend(typed(snapshot(*[{"publish_time": d} for d in days]))))
    dates = sorted(c for _, c in got)
    assert (len(dates), dates[0], dates[-1]) == (30, "2024-02-01", "2024-03-01")
    assert got["shuju_fenxi", "2024-03-01"] == 2 and got["shuju_fenxi", "2024-02-01"] == 1
    assert sum(got.values()) == 3


def test_top_and_ties(spark):
    counts = spark.createDataFrame([("s", c, v) for c, v in [("b", 2), ("a", 2), ("c", 9), ("d", 1)]], "scope_id string, category string, value long")
    got = ranking.top(counts, 2).orderBy(F.desc("value")).collect()
    assert [(r.category, r.value) for r in got] == [("c", 9), ("a", 2)]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([6, 5, 4, 3, 2, 1], {"0": 6, "1": 5, "2": 4, "3": 3, "4": 2, "5": 1}),
        ([8, 7, 6, 5, 4, 3, 2, 1], {"0": 8, "1": 7, "2": 6, "3": 5, "4": 4, "5": 3, S.OTHER: 3}),
        ([8, 7, 6, 5, 4, 3, 0], {"0": 8, "1": 7, "2": 6, "3": 5, "4": 4, "5": 3}),
        ([2], {"0": 2}),
    ],
)
def test_roll_up(spark, values, expected):
    counts = spark.createDataFrame(
        [("s", str(i), v) for i, v in enumerate(values)], "scope_id string, category string, value long"
    )
    got = ranking.top_with_other(counts)
    assert {r.category: r.value for r in got.collect()} == expected
    assert sum(expected.values()) == sum(values)


def test_city_points(spark):
    counts = spark.createDataFrame(
        [("s", "北京", 9), ("s", "上海", 4), ("s", "火星", 100), ("t", "上海", 0)],
        "scope_id string, category string, value long",
    )
    got = {(r.scope_id, r.name): r for r in geo.city_points(counts).collect()}
    assert set(got) == {("s", "北京"), ("s", "上海"), ("t", "上海")}
    assert (got["s", "北京"].lon, got["s", "北京"].lat, got["s", "北京"].symbol_size) == (116.4, 39.9, 17.0)
    assert got["s", "上海"].symbol_size == 5 + 12 * (4 / 9) ** 0.5
    assert got["t", "上海"].symbol_size == 5.0


def _separately(detail, skill_rows):
    """Every statistic on its own, as (scope, type, category) -> value."""
    plain = {t: stats.distribution(detail, t) for t in ("salary", "education", "experience", "company_size", "company_type", "financing")}
    top = {t: stats.ranked(detail, t) for t in ("top_companies", "industry")}
    rest = {"city": stats.city(detail), "publish_trend": stats.publish_trend(detail), "skills": stats.skills(skill_rows)}
    got = {}
    for stat_type, df in {**plain, **top, **rest}.items():
        for r in df.collect():
            average = r.average_salary_wan if stat_type == "city" else None
            got[r.scope_id, stat_type, r.category] = (r.value, average)
    return got


def test_one_pass_equals_the_single_statistics(postings):
    detail = typed(postings)
    skill_rows = explode_skills(detail)
    payloads = stats.statistics(detail, skill_rows, AT).cache()
    rows = packing.unpack(payloads).collect()
    got = {(r.scope_id, r.stat_type, r.category): (r.value, r.average_salary_wan) for r in rows}
    assert got == _separately(detail, skill_rows)
    summaries = {r.scope_id: json.loads(r.payload) for r in payloads.filter("stat_type = 'summary'").collect()}
    for row in stats.summary(detail).collect():
        assert summaries[row.scope_id]["data"] == {
            **{k: v for k, v in row.asDict().items() if k != "scope_id"},
            "data_updated_at": AT,
        }
    types = payloads.groupBy("scope_id").agg(F.array_sort(F.collect_list("stat_type")).alias("t")).collect()
    assert {r.scope_id: r.t for r in types} == {s: sorted(S.STAT_TYPES) for s in "ab"}


def test_payload_shapes_and_order(postings):
    detail = typed(postings)
    payloads = stats.statistics(detail, explode_skills(detail), AT).filter("scope_id = 'a'").collect()
    data = {r.stat_type: json.loads(r.payload) for r in payloads}
    assert {d["updated_at"] for d in data.values()} == {AT}
    assert list(data["city"]["data"]) == ["categories", "job_counts", "average_salary_wan"]
    for stat_type in set(S.STAT_TYPES) - {"summary", "city"}:
        assert list(data[stat_type]["data"]) == ["categories", "values"]
    labels = [n for _, n in S.SALARY_BUCKETS]
    salary = data["salary"]["data"]["categories"]
    assert salary == [n for n in labels if n in salary]
    trend = data["publish_trend"]["data"]["categories"]
    assert trend == sorted(trend) and len(trend) == 30
    for stat_type in ("city", "experience", "top_companies", "industry", "skills"):
        d = data[stat_type]["data"]
        values = d.get("values") or d["job_counts"]
        pairs = list(zip([-v for v in values], d["categories"]))
        assert pairs == sorted(pairs)
    assert len(data["top_companies"]["data"]["values"]) == 15
    assert len(data["skills"]["data"]["values"]) == 20


def test_large_statistic_is_spread_over_parts(postings):
    detail = typed(postings)
    rows = stats.statistic_rows(stats.category_counts(detail), explode_skills(detail))
    packed = packing.pack(rows, AT, part_size=4)
    sizes = packed.filter("scope_id = 'a' AND stat_type = 'publish_trend'").select("part", "parts").collect()
    assert {r.parts for r in sizes} == {8} and len({r.part for r in sizes}) > 1
    key = lambda r: (r.scope_id, r.stat_type, r.category, r.value, r.average_salary_wan)
    assert {key(r) for r in packing.unpack(packed).collect()} == {key(r) for r in rows.collect()}


def test_bundle(postings):
    detail = typed(postings)
    got = packing.bundle(stats.statistics(detail, explode_skills(detail), AT), S.COMPANY_TYPES)
    assert got.columns == ["scope_id", "part", *S.COMPANY_TYPES]
    assert all(json.loads(r[t])["updated_at"] == AT for r in got.collect() for t in S.COMPANY_TYPES)


def test_pipeline_end_to_end(spark, tmp_path, snapshot, scope):
    store = Warehouse(spark, str(tmp_path / "wh"))
    path = write_snapshot(snapshot({"raw_id": "1"}, {"raw_id": "2", "job_uid": "u2"}), str(tmp_path / "csv"), scope)
    W.load(store, scope, path, AT)
    W.publish_statistics(store, scope, AT)
    stored = store.statistics(scope)
    assert sorted(r.stat_type for r in stored.collect()) == sorted(S.STAT_TYPES)
    assert stored.exceptAll(store.statistics(scope, table="statistic_hot")).isEmpty()
    W.publish_statistics(store, scope, "2024-03-03 00:00:00")
    one = store.statistics(scope, ["skills"]).collect()
    assert len(one) == 1
    assert json.loads(one[0].payload) == {
        "data": {"categories": ["python", "sql"], "values": [2, 2]},
        "updated_at": "2024-03-03 00:00:00",
    }


def test_context_text(postings):
    detail = typed(postings)
    blocks = context.statistic_blocks(stats.statistics(detail, explode_skills(detail), AT))
    texts = {r.scope_id: r.context for r in context.scope_context(blocks, context.sample_blocks(postings)).collect()}
    whole = json.loads(texts["a"])
    assert texts["a"] == json.dumps(whole, ensure_ascii=False, indent=2)
    assert list(whole) == ["scope_id", "statistics", "job_samples"]
    assert list(whole["statistics"]) == S.STAT_TYPES
    assert len(whole["job_samples"]) == 5
    assert list(whole["job_samples"][0]) == list(S.LIST_FIELDS.values())
    cut = context.scope_context(blocks, limit=100).filter("scope_id = 'a'").first().context
    assert cut == json.dumps({k: whole[k] for k in ("scope_id", "statistics")}, ensure_ascii=False, indent=2)[:100] + S.CONTEXT_TRUNCATED


def test_context_limits(spark):
    rows = spark.createDataFrame(
        [("s", "education", f"{i:02d}" + "x" * 1300, 100 - i, None) for i in range(40)],
        "scope_id string, stat_type string, category string, value long, average_salary_wan double",
    )
    summary = spark.createDataFrame(
        [("s", 1, 2, 3, None, 4)],
        "scope_id string, job_count long, company_count long, city_count long, average_annual_salary_wan double,"
        " salary_job_count long",
    )
    odd = spark.createDataFrame(
        [("s", "skills", 0, 1, '{"categories":[],"values":[]}'), ("s", "city", 0, 1, '{"data":{"x":[1,2]},"updated_at":""}')],
        S.STATISTIC,
    )
    served = packing.pack(rows, AT).unionByName(packing.pack_summary(summary, AT)).unionByName(odd)
    text = context.scope_context(context.statistic_blocks(served), limit=10**6).first().context
    got = json.loads(text)["statistics"]
    assert got["summary"] == {"job_count": 1, "company_count": 2, "city_count": 3, "average_annual_salary_wan": None,
                              "salary_job_count": 4, "data_updated_at": AT}
    assert got["skills"] == {"categories": [], "values": []} and '"categories": []' in text
    assert got["city"] == {"x": [1, 2]}
    assert got["education"]["values"] == [100 - i for i in range(30)]
    assert got["education"]["categories"][0] == "00" + "x" * 1198 + S.TRUNCATED


def test_job_context(snapshot):
    rows = snapshot({"description": "<p>" + "y" * 3000 + "</p>", "education": None})
    got = json.loads(context.detail_context(rows).first().context)
    assert list(got) == list(S.DETAIL_FIELDS.values())
    assert got["description"] == "y" * 2000 + S.TRUNCATED
    assert got["education"] is None
