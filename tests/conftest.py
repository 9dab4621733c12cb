import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from postloom import schema as S  # noqa: E402
from postloom.session import SETTINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = SparkSession.builder.master("local[8]").appName("tests")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("catalog")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
    }
    for key, value in settings.items():
        made = made.config(key, value)
    session = made.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def snapshot(spark):
    """Frame of snapshot rows; fields left out get a plain default."""
    defaults = {
        "raw_id": "1",
        "run_id": "r1",
        "keyword": "数据分析",
        "scope_code": "shuju_fenxi",
        "scope_id": "shuju_fenxi",
        "job_uid": "u1",
        "job_name": "analyst",
        "city": "北京",
        "company": "acme",
        "salary_low": "10万",
        "salary_high": "20万",
        "publish_time": "2024-01-05 10:00:00",
        "skills": "sql|python",
    }

    def make(*rows):
        full = [{**defaults, **row} for row in rows]
        return spark.createDataFrame([tuple(r.get(c) for c in S.SNAPSHOT.names) for r in full], S.SNAPSHOT)

    return make


@pytest.fixture
def scope():
    return S.Scope("数据分析", "shuju_fenxi")
