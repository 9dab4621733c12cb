from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from postloom.functions import payload as P
from postloom.functions import text as X


def apply(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_wan_amount(spark):
    texts = ["15.5万", " 15万 ", "", None, "面议", "12.345", "123456789.1", "   ", "1万万"]
    expected = ["15.50", "15.00", None, None, None, "12.35", None, None, None]
    assert apply(spark, X.wan_amount, texts) == [e and Decimal(e) for e in expected]


def test_wan_amount_anywhere(spark):
    texts = ["15.5万", "1万5", "万", None, "面议"]
    expected = ["15.50", "15.00", None, None, None]
    assert apply(spark, X.wan_amount_anywhere, texts) == [e and Decimal(e) for e in expected]


def test_publish_date(spark):
    dates = apply(spark, X.publish_date, ["2024-01-05 10:00:00", "abc", None, "2024-1-5", "2024/01/05"])
    assert [str(d) if d else None for d in dates] == ["2024-01-05", None, None, "2024-01-05", None]


def test_blank_rules(spark):
    texts = [None, "", "  ", " a ", "b"]
    assert apply(spark, X.is_blank, texts) == [True, True, True, False, False]
    assert apply(spark, X.known_value, texts) == [None, None, None, " a ", "b"]
    assert apply(spark, X.clean_field, texts) == [None, None, None, "a", "b"]
    assert apply(spark, lambda c: X.or_label(c, "不限"), texts) == ["不限", "不限", "  ", " a ", "b"]


def test_salary_label(spark):
    pairs = [("10", "20"), ("10", None), ("", "20"), (None, ""), ("0", "0")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, lo string, hi string")
    labels = df.orderBy("i").select(X.salary_label(F.col("lo"), F.col("hi"))).collect()
    assert [r[0] for r in labels] == ["10–20", "10–—", "—–20", "面议", "0–0"]


def test_truncate(spark):
    assert apply(spark, lambda c: X.truncate(c, 3), ["abc", "abcd", None, "数据分析"]) == [
        "abc",
        "abc...(已截断)",
        None,
        "数据分...(已截断)",
    ]


def test_skill_list(spark):
    texts = ["a | b||c|", "　x\t|\n|y﻿", None, "|".join(str(i) for i in range(15))]
    assert apply(spark, X.skill_list, texts) == [
        ["a", "b", "c"],
        ["x", "y"],
        [],
        [str(i) for i in range(12)],
    ]


@pytest.mark.parametrize(
    "markup, text",
    [
        ("a<br/>b<p>c</p>&lt;b&gt;d&amp;e", "a\nb\nc\nd&e"),
        ("x &nbsp; y", "x \xa0 y"),
        ("a<BR>b< br / >c", "a\nb\nc"),
        ("<UL class='k'><li>1</li><li>2</li></UL>", "1\n2"),
        ("<pre>kept</pre><link>", "kept"),
        ("a\n \t\n\n b", "a\n b"),
        ("a<p>&nbsp;</p>b", "a\nb"),
        ("&#20013;&#x6587;&eacute;&hellip;", "中文é…"),
        ("&amp;lt;", "&lt;"),
        ("　 padded 　", "padded"),
        ("1 < 2 and 3 > 2", "1 2"),
        (None, ""),
        ("no markup", "no markup"),
    ],
)
def test_plain_text(spark, markup, text):
    assert apply(spark, X.plain_text, [markup]) == [text]


def test_fingerprints(spark):
    hashed = apply(spark, X.text_fingerprint, ["abc"])
    assert hashed == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    df = spark.createDataFrame([("1", None, "数")], "b string, a string, c string")
    both = df.select(X.row_fingerprint("a", "b", "c"), X.row_fingerprint("c", "a", "b")).first()
    expected = spark.range(1).select(F.sha2(F.lit('{"a":null,"b":"1","c":"数"}'), 256)).first()[0]
    assert both[0] == both[1] == expected
    assert df.select(X.key(F.lit("jobs"), F.col("b"))).first()[0] == "jobs:1"


@pytest.mark.parametrize(
    "keyword, pattern",
    [("a", "%a%"), ("50%", "%50%%"), (r"\%", r"%\%%"), (r"a\b", "%ab%"), ("a\\", r"%a\%")],
)
def test_like_pattern(keyword, pattern):
    assert X.like_pattern(keyword) == pattern


def test_json_is_exactly_one_value(spark):
    good = ['{"a":1}', ' {"a":[1,{"b":null}]} ', "[1]", "1", '"x"', "null", "[]", "{}"]
    bad = ["{bad", '{"a":1} x', '"k": 69}', "1,2", "1]", "1}", "", None, "[1", '1, "w": 2', "1]}", "1}]", "a"]
    assert apply(spark, P.is_json, good) == [True] * len(good)
    assert apply(spark, P.is_json, bad) == [False] * len(bad)
    assert apply(spark, lambda c: F.coalesce(P.is_json_object(c), F.lit(False)), good) == [
        True,
        True,
        False,
        False,
        False,
        False,
        False,
        True,
    ]


def test_unwrap_and_stamp(spark):
    texts = ['{"data":{"x":[1]},"updated_at":"t1"}', '{"x":1}', "[1]", "{bad", '{"data":1,"updated_at":""}']
    assert apply(spark, lambda c: F.to_json(P.unwrap(c)), texts) == ['{"x":[1]}', '{"x":1}', "[1]", None, "1"]
    assert apply(spark, P.updated_at, texts) == ["t1", None, None, None, None]


def test_quoted(spark):
    assert apply(spark, P.quoted, ["a", 'say "hi"\n', "数", None]) == ['"a"', '"say \\"hi\\"\\n"', '"数"', "null"]
