import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators.dedup import latest_postings
from postloom.operators.filters import has_uid
from postloom.operators.skills import explode_skills
from postloom.operators.typing import clean, typed
from postloom.plans import serving
from postloom.plans import warehouse as W
from postloom.sources.snapshot import read_snapshot, write_snapshot
from postloom.sources.tables import Warehouse, bootstrap, read_jdbc

AT = "2024-02-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "wh"))


def counts(df):
    return {r["table_name"]: r["row_count"] for r in df.collect()}


def column(df, name):
    return sorted(r[0] for r in df.select(name).collect())


def test_valid_rows(snapshot, scope):
    rows = snapshot(
        {"raw_id": "1"},
        *[{"raw_id": bad} for bad in ("abc", "", None, "1 2", "-1")],
        {"raw_id": "2", "keyword": "  数据分析 "},
        {"raw_id": "3", "keyword": None},
        {"raw_id": "4", "keyword": "other"},
        {"raw_id": "5", "scope_code": "x"},
        {"raw_id": "6", "scope_id": "x"},
        {"raw_id": "7", "scope_code": None},
    )
    assert column(W.valid_rows(rows, scope), "raw_id") == ["1", "2"]


def test_latest_wins_by_number(snapshot):
    rows = snapshot({"raw_id": "9"}, {"raw_id": "10"}, {"raw_id": "2", "job_uid": "u2"})
    assert column(latest_postings(rows), "raw_id") == ["10", "2"]


def test_keys_stay_untrimmed(snapshot):
    rows = snapshot({"raw_id": "1", "job_uid": "u"}, {"raw_id": "2", "job_uid": " u"})
    assert latest_postings(rows).count() == 2


def test_blank_uid_is_dropped_after_the_first_layer(snapshot, scope):
    rows = snapshot(*[{"job_uid": u} for u in ("", "  ", None, "u")])
    assert W.valid_rows(rows, scope).count() == 4
    assert rows.filter(has_uid()).count() == 1


def test_typed_projection(snapshot):
    row = typed(snapshot({"raw_id": "7", "salary_low": "15.5万", "salary_high": "面议"}))
    assert row.schema == S.DETAIL
    got = row.first()
    assert (got.raw_id, got.salary_low_wan, got.salary_high_wan) == (7, Decimal("15.50"), None)
    assert got.publish_date == date(2024, 1, 5)
    assert typed(snapshot({"raw_id": "9" * 30, "publish_time": "abc"})).first().raw_id is None


def test_skill_positions(snapshot):
    rows = snapshot(
        {"job_uid": "a", "skills": "a | b||c |"},
        {"job_uid": "b", "skills": None},
        {"job_uid": "c", "skills": ""},
        {"job_uid": "d", "skills": "a|a"},
        {"job_uid": "e", "skills": "  x  |\t|y"},
    )
    skills = explode_skills(typed(rows))
    assert skills.schema.names == S.SKILL.names
    got = sorted((r.job_uid, r.skill, r.skill_pos) for r in skills.collect())
    assert got == [
        ("a", "a", 1),
        ("a", "b", 2),
        ("a", "c", 4),
        ("d", "a", 1),
        ("d", "a", 2),
        ("e", "x", 1),
        ("e", "y", 3),
    ]


def test_clean_trims_and_nulls(snapshot):
    got = clean(snapshot({"city": "  北京 ", "company": "   ", "education": None})).first()
    assert (got.city, got.company, got.education) == ("北京", None, None)


def test_csv_dialect(spark, tmp_path):
    values = ["x, y", 'he said \\"hi\\"', "line\nbreak"] + ["v"] * (len(S.SNAPSHOT) - 3)
    header = ",".join(S.SNAPSHOT_COLUMNS)
    body = ",".join(f'"{v}"' for v in values)
    path = tmp_path / "in.csv"
    path.write_text(f"{header}\n{body}\n", encoding="utf-8")
    whole = read_snapshot(spark, str(path)).collect()
    assert len(whole) == 1
    assert tuple(whole[0])[:3] == ("x, y", 'he said "hi"', "line\nbreak")
    split = read_snapshot(spark, str(path), multi_line=False)
    assert split.count() == 2


def test_snapshot_round_trip(spark, tmp_path, snapshot, scope):
    rows = snapshot(
        {"raw_id": "1", "description": 'quote " comma , slash \\ end\\'},
        {"raw_id": "2", "description": "two\nlines"},
        {"raw_id": "3", "description": "数据"},
    )
    path = write_snapshot(rows, str(tmp_path / "csv"), scope, rows_per_file=1)
    back = {r.raw_id: r.description for r in read_snapshot(spark, path).collect()}
    assert back == {r.raw_id: r.description for r in rows.collect()}


def test_snapshot_replaces_only_its_scope(spark, tmp_path, snapshot, scope):
    other = S.Scope("other", "other")
    root = str(tmp_path / "csv")
    write_snapshot(snapshot({"raw_id": "1"}), root, scope)
    kept = write_snapshot(snapshot({"scope_id": "other"}), root, other)
    path = write_snapshot(snapshot({"raw_id": "2"}, {"raw_id": "3"}), root, scope)
    assert column(read_snapshot(spark, path), "raw_id") == ["2", "3"]
    assert read_snapshot(spark, kept).count() == 1


def _csv(tmp_path, snapshot, scope, *rows):
    return write_snapshot(snapshot(*rows), str(tmp_path / "csv"), scope)


def test_load_builds_three_layers(spark, tmp_path, snapshot, scope, store):
    path = _csv(
        tmp_path,
        snapshot,
        scope,
        {"raw_id": "9", "skills": "old"},
        {"raw_id": "10", "skills": "sql || python"},
        {"raw_id": "11", "job_uid": " "},
        {"raw_id": "x"},
    )
    got = counts(W.load(store, scope, path, AT))
    assert got == {"snapshot_raw": 3, "posting_detail": 1, "posting_skill": 2}
    assert store.read("posting_detail", scope).first().raw_id == 10
    assert column(store.read("posting_skill", scope), "skill_pos") == [1, 3]
    log = store.read("run_log", scope).collect()
    assert [(r.stage, r.status, r.rows_in, r.rows_out) for r in log] == [("load", "ok", 3, 1)]
    names = store.register(scope)
    assert spark.sql(f"SELECT count(*) FROM {names[2]}").first()[0] == 2


def test_rejected_run_keeps_the_last_good_snapshot(tmp_path, snapshot, scope, store):
    W.load(store, scope, _csv(tmp_path, snapshot, scope, {"raw_id": "1"}), AT)
    partial = _csv(tmp_path, snapshot, scope, {"raw_id": "2"}, {"raw_id": "3", "job_uid": "u3"})
    with pytest.raises(W.SnapshotRejected):
        W.load(store, scope, partial, AT, complete=False)
    nothing_valid = _csv(tmp_path, snapshot, scope, {"raw_id": "bad"})
    with pytest.raises(W.SnapshotRejected):
        W.load(store, scope, nothing_valid, AT)
    assert column(store.read("posting_detail", scope), "raw_id") == [1]
    assert column(store.read("run_log", scope), "status") == ["ok", "rejected", "rejected"]


def test_scopes_do_not_touch_each_other(tmp_path, snapshot, scope, store):
    other = S.Scope("other", "other")
    W.load(store, scope, _csv(tmp_path, snapshot, scope, {"raw_id": "1"}), AT)
    row = {"raw_id": "5", "keyword": "other", "scope_code": "other", "scope_id": "other"}
    W.load(store, other, _csv(tmp_path, snapshot, other, row), AT)
    W.load(store, scope, _csv(tmp_path, snapshot, scope, {"raw_id": "2"}), AT)
    assert column(store.read("posting_detail"), "raw_id") == [2, 5]


def test_layer_that_becomes_empty_is_emptied(tmp_path, snapshot, scope, store):
    W.load(store, scope, _csv(tmp_path, snapshot, scope, {"raw_id": "1"}), AT)
    got = W.load(store, scope, _csv(tmp_path, snapshot, scope, {"raw_id": "2", "skills": "|"}), AT)
    assert counts(got) == {"snapshot_raw": 1, "posting_detail": 1, "posting_skill": 0}


def test_layer_invariants(tmp_path, snapshot, scope, store):
    rows = [{"raw_id": str(i), "job_uid": f"u{i % 7}", "skills": "a|b" if i % 2 else None} for i in range(50)]
    W.load(store, scope, _csv(tmp_path, snapshot, scope, *rows), AT)
    raw, detail, skill = (store.read(t, scope) for t in ("snapshot_raw", "posting_detail", "posting_skill"))
    assert detail.count() <= raw.count()
    assert detail.select("scope_id", "job_uid").distinct().count() == detail.count() == 7
    assert skill.join(detail, ["scope_id", "job_uid", "raw_id"], "left_anti").isEmpty()


def test_publish_clean_feeds_the_load(tmp_path, snapshot, scope, store):
    raw = snapshot(
        {"raw_id": "1", "company": " acme "},
        {"raw_id": "2", "company": "new"},
        {"raw_id": "3", "job_uid": None},
        {"raw_id": "4", "scope_id": "other"},
    )
    path = W.publish_clean(store, raw, scope, str(tmp_path / "csv"), AT)
    serving = store.read("posting_serving", scope).collect()
    assert [(r.raw_id, r.company, str(r.created_at)) for r in serving] == [("2", "new", AT)]
    assert counts(W.load(store, scope, path, AT))["posting_detail"] == 1
    log = store.read("run_log", scope).filter("stage = 'clean'").first()
    assert (log.rows_in, log.rows_out) == (3, 1)
    with pytest.raises(W.SnapshotRejected):
        W.publish_clean(store, raw.filter("raw_id = '9'"), scope, str(tmp_path / "csv"), AT)


def test_scope_pruning_and_pushdown(store, snapshot, scope):
    store.replace("snapshot_raw", snapshot({"raw_id": "1"}, {"raw_id": "2", "scope_id": "other"}))
    plan = store.read("snapshot_raw", scope).filter(F.col("city") == "北京").select("raw_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope_id" in text
    assert "EqualTo(city,北京)" in text
    assert "ReadSchema: struct<raw_id:string,city:string>" in text


def test_posting_source(store, snapshot, scope):
    store.replace("posting_detail", typed(snapshot({"raw_id": "1"})))
    assert store.posting_source(scope).first().raw_id == 1
    with pytest.raises(ValueError):
        store.posting_source(scope, "elsewhere")


def test_bootstrap_is_repeatable(spark, tmp_path):
    location = str(tmp_path / "db")
    for _ in range(2):
        tables = bootstrap(spark, "postloom_test", location).filter("NOT isTemporary")
        assert tables.count() == 0
    spark.sql("DROP DATABASE postloom_test")


def test_jdbc_reader_asks_for_its_driver(spark):
    with pytest.raises(Exception, match="(?i)driver"):
        read_jdbc(spark, "jdbc:nosuch:x", "t", "id", 0, 10, 2)


def test_scope_code_is_checked():
    with pytest.raises(ValueError):
        S.Scope("x", "../x")


def test_scope_codes_stay_text(spark, store, snapshot):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    try:
        store.replace("snapshot_raw", snapshot({"scope_id": "007"}))
        assert column(store.read("snapshot_raw", S.Scope("k", "007")), "scope_id") == ["007"]
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")


def test_failure_in_a_later_layer_leaves_all_old_ones(tmp_path, snapshot, scope, store, monkeypatch):
    first = write_snapshot(snapshot({"raw_id": "1"}), str(tmp_path / "a"), scope)
    W.load(store, scope, first, AT)
    second = write_snapshot(snapshot({"raw_id": "2", "job_uid": "u2"}), str(tmp_path / "b"), scope)

    def broken(_):
        raise RuntimeError("typing failed")

    monkeypatch.setattr(W, "to_detail", broken)
    with pytest.raises(RuntimeError):
        W.load(store, scope, second, AT)
    assert {str(r.raw_id) for t in ("snapshot_raw", "posting_detail", "posting_skill") for r in store.read(t).collect()} == {"1"}
    assert [r.status for r in store.read("run_log").collect()].count("failed") == 1
    monkeypatch.undo()
    W.load(store, scope, second, AT, multi_line=False)
    assert {str(r.raw_id) for r in store.read("posting_skill").collect()} == {"2"}


def test_statistics_never_go_stale(tmp_path, snapshot, scope, store):
    """A newer snapshot without skills, dates and salaries empties those statistics in both tiers."""
    for number, row in enumerate([{}, {"skills": None, "salary_low": "面议", "publish_time": "未知"}]):
        path = write_snapshot(snapshot({"raw_id": str(number + 1), **row}), str(tmp_path / str(number)), scope)
        W.load(store, scope, path, AT)
        W.publish_statistics(store, scope, f"2024-01-0{number + 1} 00:00:00")
    for table in ("statistic", "statistic_hot"):
        rows = {r.stat_type: json.loads(r.payload) for r in store.statistics(scope, table=table).collect()}
        assert sorted(rows) == sorted(S.STAT_TYPES)
        assert {p["updated_at"] for p in rows.values()} == {"2024-01-02 00:00:00"}
        for empty in ("skills", "salary", "publish_trend"):
            assert rows[empty]["data"] == {"categories": [], "values": []}
    payloads, _ = serving.dashboard(store.read("statistic_hot"), store.read("statistic"), scope.scope_id, "all")
    assert payloads.count() == len(S.STAT_TYPES)


def test_hot_tier_is_refilled_from_the_durable_one(tmp_path, snapshot, scope, store):
    path = write_snapshot(snapshot({"raw_id": "1"}), str(tmp_path / "csv"), scope)
    W.load(store, scope, path, AT)
    W.publish_statistics(store, scope, AT)
    broken = store.statistics(scope, ["skills", "city"], "statistic_hot").withColumn("payload", F.lit("{bad")).select(*S.STATISTIC.names)
    store.replace("statistic_hot", store.spark.createDataFrame(broken.collect(), S.STATISTIC))
    serving.repair(store, scope)
    hot = {r.stat_type: r.payload for r in store.statistics(scope, table="statistic_hot").collect()}
    assert hot == {r.stat_type: r.payload for r in store.statistics(scope).collect()}
