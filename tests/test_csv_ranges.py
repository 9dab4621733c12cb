"""CSV with quoted line breaks, cut at every place, against Spark's reader of whole files."""

import random

import pytest

from postloom import schema as S
from postloom.sources import csv_ranges
from pyspark.sql import types as T

OPTIONS = {"sep": ",", "quote": '"', "escape": "\\", "header": "true", "emptyValue": ""}
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])


def whole(spark, path):
    return spark.read.schema(SCHEMA).options(**OPTIONS, multiLine="true", enforceSchema="true").csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def ranges_of(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    for key, value in before.items():
        spark.conf.set(key, value)


TEXT = (
    'a,b,c\n1,"x\ny",z\n"q \\"in\\" , q","line\n\n""odd"" \\\\",plain "quote" here\n,,""\n'
    '"long\nfield\nof\nmany\nlines, with commas\nand \\"quotes\\"\nthat\nfills\nranges",2,3\n\n7,8,"9"\n"un","clo\\\\","sed"\n'
)


@pytest.mark.parametrize("size", [*range(1, 12), 17, 23, 40, 64, 100, 1000])
def test_every_border(spark, tmp_path, ranges_of, size):
    (tmp_path / "f.csv").write_text(TEXT)
    expected = rows(whole(spark, str(tmp_path)))
    assert len(expected) == 6
    ranges_of(size)
    assert rows(csv_ranges.read(spark, str(tmp_path), SCHEMA, OPTIONS)) == expected


def test_many_files_windows_line_ends_and_headers_with_breaks(spark, tmp_path, ranges_of):
    (tmp_path / "f.csv").write_bytes(TEXT.replace("\n", "\r\n").encode())
    (tmp_path / "g.csv").write_text('"a\nhead","b\nof\nlines",c\n1,2,"3\n4"\n')
    (tmp_path / "h.csv").write_text("a,b,c\n")
    (tmp_path / "i.csv").write_text("\n\na,b,c\n5,6,7")
    expected = sorted(r for f in "fghi" for r in map(repr, rows(whole(spark, str(tmp_path / f"{f}.csv")))))
    for size in (5, 30, 10_000):
        ranges_of(size)
        assert sorted(map(repr, rows(csv_ranges.read(spark, str(tmp_path), SCHEMA, OPTIONS)))) == expected


def test_random_files(spark, tmp_path, ranges_of):
    draw = random.Random(4)
    for n in range(6):
        fields = ["x", "", "a b", "l\nm", "q,r", '\\"', "\\\\", "数据\n", "é"]
        quoted = lambda: '"' + "".join(draw.choice(fields) for _ in range(draw.randint(0, 6))) + '"'
        plain = lambda: draw.choice(["", "x", "7", "a b", 'in"side'])
        lines = [",".join(draw.choice([quoted, plain])() for _ in "abc") for _ in range(40)]
        (tmp_path / f"{n}.csv").write_text("a,b,c\n" + "\n".join(lines) + "\n")
    expected = rows(whole(spark, str(tmp_path)))
    for size in (50, 333):
        ranges_of(size)
        assert rows(csv_ranges.read(spark, str(tmp_path), SCHEMA, OPTIONS)) == expected


def test_one_file_is_many_tasks(spark, tmp_path, ranges_of):
    (tmp_path / "f.csv").write_text("a,b,c\n" + '1,"x\ny",z\n' * 2_000)
    ranges_of(1_000)
    found = csv_ranges.records(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 20
    assert found.count() == 2_000


def test_states_follow_from_the_ranges_before():
    class Row(dict):
        __getattr__ = dict.__getitem__

    def made(block, out_ends, in_ends, in_closes):
        return Row(file="f", block=block, out_ends=out_ends, in_ends=in_ends, in_closes=in_closes)

    begins = csv_ranges._beginnings([made(30, True, False, True), made(0, True, False, True), made(10, False, True, False), made(20, False, True, True)])
    assert begins == {("f", 0): (False, None), ("f", 10): (True, 0), ("f", 20): (True, 0), ("f", 30): (True, 20)}


def test_empty_folder_of_headers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("")
    assert csv_ranges.read(spark, str(tmp_path), SCHEMA, OPTIONS).count() == 0
    assert S.SNAPSHOT.names  # the snapshot reader itself is covered in test_warehouse
