"""Keyword search by bigrams against the plain filter."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators import search_index
from postloom.operators.filters import matches_keyword
from postloom.operators.paging import with_order_columns
from postloom.sources.tables import Warehouse


@pytest.fixture
def serving(snapshot):
    def make(*rows):
        stamped = with_order_columns(snapshot(*rows).withColumn("created_at", F.lit(None).cast("timestamp")))
        return stamped.select(*S.SERVING.names)

    return make


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


ROWS = [
    {"raw_id": "1", "job_name": "Data Analyst", "skills": "SQL|Python", "description": "a b"},
    {"raw_id": "2", "job_name": "数据分析师", "company": "上海公司", "skills": None},
    {"raw_id": "3", "job_name": "100% remote", "description": "under_score \\ back"},
    {"raw_id": "4", "job_name": "x", "company": "y", "skills": "", "description": ""},
    {"raw_id": "5", "job_name": "ΑΣ ΟΔΟΣ İstanbul 😀x", "scope_id": "other"},
    {"raw_id": "6", "job_name": "da", "company": "ta", "description": "dada tata", "scope_id": "other"},
]
KEYWORDS = ["data", "DATA an", "数据", "公司", "100\\%", "r_s", "a%b", "%", "_", "x", "", "  ", "\\\\", "ΑΣ", "οδος", "😀", "😀x", "istanbul",
            "İstanbul", "data%sql", "sql|py", "zz"]


@pytest.mark.parametrize("listed", [0, 1_000])
def test_equals_the_filter(serving, store, listed):
    rows = serving(*ROWS)
    search_index.build(store, rows)
    for keyword in KEYWORDS:
        plain = matches_keyword(keyword)
        expected = sorted(r.raw_id for r in (rows if plain is None else rows.filter(plain)).collect())
        found = search_index.find(store, keyword, listed=listed)
        assert sorted(r.raw_id for r in found.collect()) == expected, keyword
    assert [r.raw_id for r in search_index.find(store, "da", "other", listed).collect()] == ["6"]


def test_scopes_are_replaced_alone(serving, store):
    search_index.build(store, serving(*ROWS))
    search_index.build(store, serving({"raw_id": "9", "job_name": "New words", "scope_id": "other"}))
    assert [r.raw_id for r in search_index.find(store, "new words").collect()] == ["9"]
    assert search_index.find(store, "tata").count() == 0
    assert search_index.find(store, "data analyst").count() == 1


def test_hot_bigram_is_many_lists(spark, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 100)
    rows = spark.range(3_000).select(
        F.lit("s").alias("scope_id"),
        F.col("id").alias("doc"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot "), F.col("id").cast("string"))).alias("job_name"),
        *[F.lit(None).cast("string").alias(c) for c in S.SEARCH_COLUMNS[1:]],
    )
    lists = search_index.postings_lists(rows).cache()
    hot = lists.filter("gram = 'ho'")
    assert hot.count() == 30 and hot.agg(F.max(F.size("offsets"))).first()[0] <= 34
    found = search_index.candidates(lists, ["ho", "ot", "27", "70"])
    assert sorted(r.doc for r in found.collect()) == [n for n in range(0, 3_000, 3) if "27" in str(n) and "70" in str(n)]


def test_only_candidates_are_read(serving, store):
    search_index.build(store, serving(*ROWS))
    plan = search_index.find(store, "analyst")._jdf.queryExecution().executedPlan().toString()
    assert "In(doc" in plan or "EqualTo(doc" in plan
    index = search_index.candidates(store.read("keyword_index"), ["an", "na"])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [an,na])" in index
    joined = search_index.find(store, "analyst", listed=0)._jdf.queryExecution().optimizedPlan().toString()
    assert all("Join Inner" in line for line in joined.split("\n") if "lower(job_name" in line)  # tried on joined rows only
    assert "lower(job_name" in joined


def test_empty(serving, store):
    search_index.build(store, serving(*ROWS))
    assert search_index.candidates(store.read("keyword_index").limit(0), ["ab"]).count() == 0


def test_lists_are_made_before_the_shuffle(spark, monkeypatch):
    """Tasks hand on a list for each bigram and block, however the texts are parted; pairs are never single rows."""
    monkeypatch.setattr(search_index, "BLOCK", 100)
    rows = spark.range(1_000).select(
        F.when(F.col("id") % 7 > 0, F.lit("s")).alias("scope_id"),
        F.col("id").alias("doc"),
        F.concat(F.lit("😀İa "), F.col("id").cast("string")).alias("job_name"),
        *[F.lit(c).alias(c) for c in S.SEARCH_COLUMNS[1:]],
    )
    lists = search_index.postings_lists(rows)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInPandas" in plan and plan.count("Exchange") == 1
    found = sorted(map(repr, lists.collect()))
    texts = rows.select("scope_id", "doc", F.explode(F.array(*[F.lower(c) for c in S.SEARCH_COLUMNS])).alias("text")).collect()
    expected = {}
    for r in texts:
        for a, b in zip(r.text, r.text[1:], strict=False):
            expected.setdefault((a + b, r.doc // 100, r.scope_id), set()).add(r.doc % 100)
    assert found == sorted(repr(Row(gram=g, block=k, offsets=sorted(v), scope_id=s)) for (g, k, s), v in expected.items())
    monkeypatch.setattr(search_index, "TOGETHER", 50)
    assert sorted(map(repr, search_index.postings_lists(rows).collect())) == found
