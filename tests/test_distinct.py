"""Distinct counts merged from bitmaps against direct counts."""

import random
from datetime import date

import pytest

from postloom.plans import distinct
from postloom.sources.tables import Warehouse

KIND = "scope_id string, company string, city string, publish_date date"
DAYS = [date(2024, 1, d) for d in range(1, 6)] + [None]


def postings(choose, n, companies):
    def one():
        company = choose.choice([None, "", "  ", *(["hot"] * companies), *(f"c{k}" for k in range(companies))])
        return choose.choice("xyz"), company, choose.choice(["a", "b", None]), choose.choice(DAYS)

    return [one() for _ in range(n)]


def direct(rows, by):
    out = {}
    for row in rows:
        group = out.setdefault(tuple(by(row)), (set(), set()))
        for k in (1, 2):
            if row[k] and row[k].strip(" "):
                group[k - 1].add(row[k])
    return {k: (len(a), len(b)) for k, (a, b) in out.items() if a or b}


def found(store, *by):
    rows = distinct.counted(distinct.bitmaps(store), *by).collect()
    return {tuple(r[:-2]): (r.company_count, r.city_count) for r in rows}


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "store"))


def check(store, rows):
    assert found(store, "scope_id", "day") == direct(rows, lambda r: (r[0], r[3]))
    assert found(store, "scope_id") == direct(rows, lambda r: r[:1])
    assert found(store, "day") == direct(rows, lambda r: (r[3],))
    assert found(store) == (direct(rows, lambda r: ()) or {(): (0, 0)})


def test_merged_over_days_and_scopes(spark, store):
    rows = postings(random.Random(3), 900, 60)
    early = [r for r in rows if r[3] in DAYS[:2]]
    distinct.update(store, spark.createDataFrame(early, KIND))
    check(store, early)
    distinct.update(store, spark.createDataFrame([r for r in rows if r[3] not in DAYS[:2]], KIND))
    check(store, rows)
    numbers = [r.number for r in distinct.dictionary(store).collect()]
    assert len(numbers) == len(set(numbers)) == len({(k, r[k]) for r in rows for k in (1, 2) if r[k] and r[k].strip()})


def test_changed_and_emptied_days(spark, store):
    rows = postings(random.Random(4), 400, 20)
    distinct.update(store, spark.createDataFrame(rows, KIND))
    changed = [("x", "new", "b", DAYS[0])]
    gone = spark.createDataFrame([(DAYS[1],), (None,)], "day date")
    distinct.update(store, spark.createDataFrame(changed, KIND), gone)
    check(store, [r for r in rows if r[3] not in (DAYS[0], DAYS[1], None)] + changed)


def test_many_buckets(spark, store):
    n = 3 * distinct.WIDTH + 7
    rows = spark.range(n).selectExpr("'x' AS scope_id", "'c' || id AS company", "'a' AS city", "DATE'2024-01-01' AS publish_date")
    distinct.update(store, rows)
    distinct.update(store, rows.selectExpr("scope_id", "company || 'x' AS company", "city", "DATE'2024-01-02' AS publish_date"))
    assert found(store, "day") == {(date(2024, 1, d),): (n, 1) for d in (1, 2)}
    assert found(store) == {(): (2 * n, 1)}


def test_empty(spark, store):
    distinct.update(store, spark.createDataFrame([], KIND))
    assert found(store) == {} or found(store) == {(): (0, 0)}
    distinct.update(store, spark.createDataFrame([("x", None, " ", None)], KIND))
    assert found(store, "scope_id") == {}


def test_counting_reads_no_postings(spark, store):
    distinct.update(store, spark.createDataFrame(postings(random.Random(5), 50, 5), KIND))
    one_day = distinct.bitmaps(store).filter("day = DATE'2024-01-02'")
    counts = distinct.counted(one_day, "scope_id")
    files = counts.inputFiles()
    assert files and all("/distinct_bitmap/" in f for f in files)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
