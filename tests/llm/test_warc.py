"""Archives, the capture index and the records read back."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from postloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, key int, archive string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    def make(*rows):
        return spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA)

    return make


def expected(rows):
    order = lambda i: (i is not None, i or 0)
    firsts = {}
    for i, _, html in rows:
        firsts[html or ""] = min([i, firsts.get(html or "", i)], key=order)
    out = []
    for i, _, html in rows:
        first = firsts[html or ""]
        kind = ("response", None) if first == i else ("revisit", first)
        out.append((i, len((html or "").encode()), digest(html), *kind))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://www.Example.com:80/a?b=1#c", "same"),
    (2, "https://example.com", "same"),
    (9, "https://user@sub.example.com/ü ü", "<p>größer\r\n\r\n</p>"),
    (7, None, None),
    (8, "no url\r\nWARC-Type: revisit", ""),
    (-4, "http://a.b/", "x" * 300_000),
    (11, "http://a.b/", "same"),
    (2**62 + 1, "http://a.b/", "<p>größer\r\n\r\n</p>"),
]


def test_round_trip(pages):
    found = warc.round_trip(pages(*ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(ROWS)


def test_small_payloads_are_responses(pages):
    found = warc.round_trip(pages(*ROWS), least_bytes=10).collect()
    assert {r.page_id for r in found if r.record_type == "revisit"} == {2**62 + 1}


def test_empty_null_and_repeated_rows(pages):
    assert warc.round_trip(pages().limit(0)).count() == 0
    rows = [(None, "http://a/", "p"), (3, "http://a/", "p"), (4, "http://b/", "q"), (4, "http://b/", "q")]
    found = sorted((tuple(r)[0:1] + tuple(r)[4:6] for r in warc.round_trip(pages(*rows)).collect()), key=repr)
    assert found == sorted([(None, "response", None), (3, "revisit", None), (4, "response", None), (4, "response", None)], key=repr)


def test_keys(spark):
    urls = ["http://www.Example.com:8080/a?b#c", "https://u:p@a.b", "plain text", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("k")).collect()
    assert [r.k for r in rows] == ["com,example,www:8080)/a?b", "b,a)/", ")plain text", ")/"]


def test_look_up_reads_blocks_of_the_key_only(spark, pages, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 40}.example/{i}", f"page {i}") for i in range(800)]
    rows += [(i, "http://hot.example/", f"page {i}") for i in range(1000, 1400)]
    captures = warc.archived(pages(*rows), f"{tmp_path}/archives", archive_bytes=20_000)
    assert captures.select("archive").distinct().count() > 4
    index = warc.indexed(captures, f"{tmp_path}/index", block_lines=8, file_lines=100)
    assert len(index.files) >= 12
    keys = spark.createDataFrame([("example,hot)/",), ("example,h7)/47",), ("example,none)/",)], "key string")
    found = warc.captured(index, keys)
    records = warc.read(f"{tmp_path}/archives", found).collect()
    assert sorted(r.page_id for r in records) == [47, *range(1000, 1400)]
    assert {r.payload.decode() for r in records} == {f"page {r.page_id}" for r in records}
    name, *_, at, length = index.files[0]
    file = warc.IndexFile(index.folder, name, at, length)
    read = []
    monkeypatch.setattr(warc.IndexFile, "_open", lambda self, n, real=warc.IndexFile._open: (read.append(n), real(self, n)))
    key = file.firsts[len(file.firsts) // 2]
    assert list(file.found(key)) and len(read) <= 3 + key.startswith(b"example,hot") * len(file.firsts)
    warc.removed(index.folder)


def test_archives_are_plain_members(pages, tmp_path):
    warc.archived(pages(*ROWS[:2]), str(tmp_path))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.count(b"WARC-Type: revisit\r\n") == 1
    assert b"WARC-Refers-To: <urn:page:2>\r\n" in raw and raw.count(b"same") == 1


def test_damage_is_noticed():
    raw = warc.record(1, "http://a/", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.opened(raw)[2:5] == (3, digest("abc"), "response")
    with pytest.raises(ValueError):
        warc.opened(raw.replace(b"abc", b"abd"))
