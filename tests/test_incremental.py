"""Statistics from stored counts against a full recount."""

import random

import pytest

from postloom import schema as S
from postloom.operators.skills import explode_skills
from postloom.operators.typing import typed
from postloom.plans import incremental
from postloom.plans.statistics import statistics
from postloom.sources.tables import Warehouse

AT = "2024-02-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def posting(draw, number):
    blank = lambda *values: draw.choice([*values, "", None])
    return {
        "raw_id": str(number),
        "job_uid": f"u{number}",
        "scope_id": draw.choice(["a", "b"]),
        "city": blank("x", "y", "未知"),
        "company": blank("c1", "c2", "c3"),
        "salary_low": blank("10万", "3.55万"),
        "salary_high": blank("20万", "5万"),
        "education": blank("e1", "e2"),
        "publish_time": blank("2024-01-05 10:00:00", "2024-01-20 10:00:00"),
        "skills": blank("sql|python", "sql", "go||sql"),
    }


def rows(df):
    return {(r.scope_id, r.stat_type, r.part): r.payload for r in df.collect()}


def recount(detail):
    return rows(statistics(detail, explode_skills(detail), AT))


def test_equals_a_recount_after_inserts_updates_and_removals(snapshot, store):
    draw = random.Random(1)
    state = {n: posting(draw, n) for n in range(40)}
    incremental.update(store, typed(snapshot(*state.values())))
    for turn in (1, 2):
        gone = draw.sample(sorted(state), 12)
        removed = [state.pop(n) for n in gone]
        fresh = {n: posting(draw, n) for n in [*gone[:6], *range(100 * turn, 100 * turn + 5)]}
        state.update(fresh)
        incremental.update(store, typed(snapshot(*fresh.values())), typed(snapshot(*removed)))
        full = typed(snapshot(*state.values()))
        assert rows(incremental.payloads(store.read("statistic_count"), AT)) == recount(full)


def test_only_changed_scopes_are_written(snapshot, store, tmp_path):
    first = [{"raw_id": "1", "scope_id": "a"}, {"raw_id": "2", "scope_id": "b"}]
    incremental.update(store, typed(snapshot(*first)))
    files = lambda scope: sorted(p.name for p in (tmp_path / "wh/statistic_count" / f"scope_id={scope}").glob("part-*"))
    before = files("b")
    assert incremental.update(store, typed(snapshot({"raw_id": "3", "scope_id": "a"}))) == ["a"]
    assert files("b") == before
    assert incremental.update(store, typed(snapshot().limit(0)), typed(snapshot(first[1]))) == ["b"]
    assert {r.scope_id for r in store.read("statistic_count").collect()} == {"a"}


def test_a_change_that_changes_no_count(snapshot, store):
    row = {"raw_id": "1", "scope_id": "a"}
    incremental.update(store, typed(snapshot(row)))
    assert incremental.update(store, typed(snapshot(row)), typed(snapshot(row))) == []
    assert S.STATISTIC_COUNT.names == store.read("statistic_count").columns
