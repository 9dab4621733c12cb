"""The bucketed table of newest postings."""

import pytest

from postloom.operators.dedup import latest_postings
from postloom.operators.filters import has_uid
from postloom.sources.buckets import BucketedPostings


@pytest.fixture
def stored(spark, tmp_path, request):
    made = BucketedPostings(spark, f"t_{abs(hash(request.node.name))}", str(tmp_path), buckets=4)
    yield made
    spark.sql(f"DROP VIEW IF EXISTS {made.name}")
    for version in range(1, made.version() + 1):
        spark.sql(f"DROP TABLE IF EXISTS {made.name}_v{version}")


def rows(df):
    return sorted((r.scope_code, r.job_uid, r.raw_id, r.job_name) for r in df.collect())


def test_equals_a_full_dedup(snapshot, stored):
    first = snapshot(*[{"raw_id": str(i), "job_uid": f"u{i % 7}", "scope_code": "ab"[i % 2]} for i in range(30)])
    second = snapshot(
        *[{"raw_id": str(i), "job_uid": f"u{i % 9}", "scope_code": "abc"[i % 3], "job_name": "new"} for i in range(20, 50)],
        {"raw_id": "3", "job_uid": "u0", "scope_code": "a", "job_name": "late but old"},
        {"raw_id": "9", "job_uid": " "},
        {"raw_id": "9", "job_uid": None},
    )
    stored.merge(first)
    merged = stored.merge(second)
    assert rows(merged) == rows(latest_postings(first.union(second).filter(has_uid())))
    assert rows(stored.spark.table(stored.name)) == rows(merged)


def test_ties_stay_and_versions_are_dropped(snapshot, stored):
    stored.merge(snapshot({"job_name": "first"}))
    assert rows(stored.merge(snapshot({"job_name": "second"})))[0][3] == "first"
    stored.merge(snapshot({"raw_id": "x", "job_name": "no number"}))
    assert rows(stored.merge(snapshot({"raw_id": "2", "job_name": "third"}))) == [("shuju_fenxi", "u1", "2", "third")]
    assert {t.tableName for t in stored.spark.sql(f"SHOW TABLES LIKE '{stored.name}_v*'").collect()} == {f"{stored.name}_v{n}" for n in (3, 4)}


def test_the_stored_side_is_not_shuffled(snapshot, stored):
    stored.merge(snapshot(*[{"raw_id": str(i), "job_uid": f"u{i}"} for i in range(50)]))
    plan = stored.merged(snapshot({"raw_id": "77"}))._jdf.queryExecution().executedPlan().toString()
    join = plan.index("SortMergeJoin")
    left, right = plan[join:].split("+- Sort", 1)[0], plan[join:]
    scan = next(i for i, line in enumerate(right.split("\n")) if "FileScan orc" in line)
    above = right.split("\n")[1 : scan + 1]
    assert not any("Exchange" in line for line in above) and left
    assert right.count("Exchange hashpartitioning(job_uid") <= 1


def test_a_look_up_reads_one_bucket(snapshot, stored, tmp_path):
    stored.merge(snapshot(*[{"raw_id": str(i), "job_uid": f"u{i}"} for i in range(50)]))
    mine = stored.read().filter("job_uid = 'u7'").select("_metadata.file_name").first()[0]
    others = [p for p in tmp_path.rglob("part-*") if p.name != mine]
    assert len(others) == 3
    for path in others:  # whoever reads these fails
        path.write_bytes(b"no ORC")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    stored.spark.catalog.refreshTable(f"{stored.name}_v1")
    assert [r.job_id for r in stored.detail("u7").collect()] == ["u7"]
    with pytest.raises(Exception):
        stored.read().collect()
