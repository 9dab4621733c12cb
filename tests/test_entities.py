"""Entities and canonical JSON against the standard library's own functions."""

import hashlib
import html
import json
import random
from html.entities import html5

from pyspark.sql import functions as F

from postloom.functions import payload as P
from postloom.functions import text as X
from postloom.functions.entities import unescape


def decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").repartition(4)
    return [r[1] for r in df.select("i", unescape(F.col("v"))).orderBy("i").collect()]


def test_every_named_entity(spark):
    texts = [f"a&{form}b &{form};&{form}1" for name in html5 for form in (name, name.rstrip(";"), name[:-1])]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_every_kind_of_number(spark):
    numbers = [*range(0x180), *range(0xD7F0, 0xE010), *range(0xFDC0, 0xFE00), 0xFEFF, *range(0xFFF0, 0x10010)]
    numbers += [plane << 16 | low for plane in range(1, 18) for low in (0, 0xFFFD, 0xFFFE, 0xFFFF)]
    numbers += [9999999, 10**8, 16**7, 10**40]
    texts = [t for n in numbers for t in (f"&#{n};", f"&#00{n}x", f"&#x{n:x};", f"x&#X000{n:X} ")]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_random_text(spark):
    choose = random.Random(5)
    parts = ["&", "#", "x", ";", "amp", "lt", "notit", "not", "NotEqualTilde", "frac12", "12", "é", "\U0001f600", " ", "\n", "<", "&&", "$1", "\\"]
    texts = ["".join(choose.choices(parts, k=choose.randint(0, 14))) for _ in range(3000)]
    texts += ["", "&", "&&", "&" + "a" * 40 + ";", "&amp;" * 3000, None]
    assert decoded(spark, texts) == [t and html.unescape(t) for t in texts]


def test_plan_needs_no_python_worker(spark):
    rows = spark.range(3).select(X.plain_text(F.concat(F.lit("&eacute;"), F.col("id").cast("string"))).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.collect()[0].t == "é0"


def nested(choose, depth):
    kind = choose.randrange(7 if depth else 5)
    if kind < 5:
        return [None, True, choose.randrange(-(10**12), 10**12), choose.choice(["", "数", 'a"b\\', "x\ny"]), 1.5][kind]
    if kind == 5:
        return [nested(choose, depth - 1) for _ in range(choose.randrange(4))]
    return {choose.choice("zyxwabcé") + choose.choice(["", "1", "Z"]): nested(choose, depth - 1) for _ in range(choose.randrange(6))}


def test_keys_are_sorted_at_every_depth(spark):
    choose = random.Random(8)
    values = [nested(choose, 5) for _ in range(400)] + [{"b": {"d": [{"f": 1, "e": None}], "c": {}}, "a": []}]
    texts = [json.dumps(v, ensure_ascii=choose.random() < 0.5, indent=choose.choice([None, 1])) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    rows = df.select("i", P.canonical(F.col("v")), X.json_fingerprint(F.col("v"))).orderBy("i").collect()
    want = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]
    assert [r[1] for r in rows] == want
    assert [r[2] for r in rows] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_bad_json_has_no_fingerprint(spark):
    df = spark.createDataFrame([("{bad",), ('{"a":1} x',), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(X.json_fingerprint(F.col("v"))).collect()] == [None] * 4
