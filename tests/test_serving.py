import pytest

from postloom import schema as S
from postloom.plans import serving

GOOD = '{"data":{"categories":["x"],"values":[1]},"updated_at":"2024-01-01"}'
NEWER = '{"data":{},"updated_at":"2024-02-02"}'


@pytest.fixture
def tier(spark):
    def make(*rows):
        full = [(s, t, *(p if isinstance(p, tuple) else (0, 1, p))) for s, t, p in rows]
        return spark.createDataFrame(full, S.STATISTIC)

    return make


def served(df):
    return {(r.scope_id, r.stat_type, r.part): r.payload for r in df.collect()}


def test_hot_wins_when_it_is_a_valid_object(tier):
    hot = tier(("a", "city", NEWER), ("a", "salary", "[1]"), ("a", "skills", "{bad"), ("a", "summary", None))
    durable = tier(*[("a", t, GOOD) for t in ("city", "salary", "skills", "summary", "industry")])
    assert served(serving.serve(hot, durable)) == {
        ("a", "city", 0): NEWER,
        **{("a", t, 0): GOOD for t in ("salary", "skills", "summary", "industry")},
    }


def test_durable_may_be_any_json_but_not_broken(tier):
    durable = tier(("a", "city", "[1]"), ("a", "salary", "{bad"), ("a", "skills", None), ("a", "summary", GOOD + " x"))
    assert served(serving.serve(tier(), durable)) == {("a", "city", 0): "[1]"}


def test_only_requested_types_are_read(tier):
    durable = tier(("a", "city", GOOD), ("a", "salary", GOOD))
    assert served(serving.serve(tier(), durable, ["salary"])) == {("a", "salary", 0): GOOD}


def test_incomplete_parts_fall_back(tier):
    hot = tier(("a", "city", (0, 2, NEWER)), ("a", "city", (1, 2, "{bad")))
    durable = tier(("a", "city", (0, 2, GOOD)), ("a", "city", (1, 2, GOOD)), ("a", "salary", (0, 2, GOOD)))
    assert served(serving.serve(hot, durable)) == {("a", "city", 0): GOOD, ("a", "city", 1): GOOD}


def test_coverage_gap(spark, tier):
    scopes = spark.createDataFrame([("a",), ("b",)], "scope_id string")
    found = serving.serve(tier(("a", "city", GOOD)), tier(("a", "salary", GOOD), ("b", "city", GOOD)))
    gap = serving.coverage_gap(scopes, found, ["city", "salary", "skills"]).collect()
    assert {tuple(r) for r in gap} == {("a", "skills"), ("b", "salary"), ("b", "skills")}


def test_latest_update(tier):
    rows = tier(("a", "city", GOOD), ("a", "salary", NEWER), ("a", "skills", "[1]"), ("b", "city", '{"data":1}'))
    got = {r.scope_id: r.updated_at for r in serving.latest_update(rows).collect()}
    assert got == {"a": "2024-02-02", "b": None}


def test_unwrapped(tier):
    rows = tier(("a", "city", GOOD), ("a", "salary", '{"x":1}'))
    got = {r.stat_type: r.payload for r in serving.unwrapped(rows).collect()}
    assert got == {"city": '{"categories":["x"],"values":[1]}', "salary": '{"x":1}'}


def test_dashboard_view(tier):
    durable = tier(("a", "city", GOOD), ("a", "salary", NEWER), *[("a", t, GOOD) for t in S.COMPANY_TYPES], ("b", "city", NEWER))
    payloads, stamp = serving.dashboard(tier(), durable, "a", "company")
    assert {r.stat_type for r in payloads.collect()} == set(S.COMPANY_TYPES)
    assert stamp.first().updated_at == "2024-01-01"
    with pytest.raises(LookupError, match="a: summary, education, experience, industry, publish_trend, skills"):
        serving.dashboard(tier(), durable, "a")
