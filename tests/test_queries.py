"""Every registered query against its SQL in DuckDB, on the driver's tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[: -len(".parquet")] for f in sorted(os.listdir(SF_DIR)) if f.endswith(".parquet")]

_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "decimal(10,2)": "DECIMAL(10,2)",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    expected = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert {n: _KINDS[t] for n, t in df.dtypes} == {c[0]: str(c[1]) for c in expected.description}
    assert _rows(df.collect(), df.columns) == _rows(expected.fetchall(), names)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["scope_id", "category", "value"]
    assert rows.count() > 0


def test_search_leaves_four_facets_open(spark):
    rows = entry.queries()["job_search"](spark, SF_DIR).collect()
    assert {r.education for r in rows} == {"O"}
    assert all(len({r[c] for r in rows}) > 1 for c in ("city", "experience", "company_size", "industry"))
