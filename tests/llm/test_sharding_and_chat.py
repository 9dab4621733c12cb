"""Sharding and preference formatting."""

import os
import zlib

import duckdb
from pyspark.sql import functions as F

from postloom.llm import chat, queries, sharding

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sharded(df, shards=5, **options):
    return sharding.shard(df, F.lit(100), shards, **options)


def test_shards_hold_every_record_once(texts):
    rows = texts(*[(i, f"t{i}") for i in range(400)], *[(7, "same")] * 250, (None, None), (None, None))
    found = sharded(rows, bucket_bytes=10_000).toPandas()
    assert list(found.columns) == ["doc_id", "text", "part", "rank", "shard", "slot"]
    count = lambda df: df.groupby(["doc_id", "text"], dropna=False).size().to_dict()
    assert sorted(count(found).values()) == sorted(count(rows.toPandas()).values()) and len(found) == 652
    sizes = found.groupby("shard").size()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = sharded(rows, bucket_bytes=10_000).toPandas()
    key = ["shard", "slot"]
    assert found.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    other = sharded(rows, bucket_bytes=10_000, seed=18).toPandas()
    assert not found.sort_values(key)["text"].reset_index(drop=True).equals(other.sort_values(key)["text"].reset_index(drop=True))
    assert sharded(texts().limit(0)).count() == 0


def test_order_is_shuffled_and_written(texts, spark, tmp_path):
    found = sharding.external_shuffle(texts(*[(i, "t") for i in range(500)]), F.lit(100), bucket_bytes=20_000)
    by_place = [r.doc_id for r in found.orderBy("position").collect()]
    assert sorted(by_place) == list(range(500)) and by_place != sorted(by_place)
    assert sum(a + 1 == b for a, b in zip(by_place, by_place[1:], strict=False)) < 20
    path = str(tmp_path / "shards")
    sharding.write_shards(sharded(texts(*[(i, "t") for i in range(100)])), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 5
    assert spark.read.parquet(path).count() == 100


def test_query_shards_whole_documents(spark, monkeypatch):
    kept, write = [], sharding.write_shards

    def written(sharded, path, files_per_shard=1):
        kept.append((sharded, path))
        write(sharded, path, files_per_shard)

    monkeypatch.setattr(sharding, "write_shards", written)
    found = {r.doc_id: r for r in queries.op7_sharding(spark, SF_DIR).collect()}
    (sharded, path), = kept
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stored = spark.read.parquet(path)
    assert stored.select(*docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(stored.select(*docs.columns)).isEmpty()
    assert len(found) == docs.count() == stored.count()
    for r in stored.collect():
        raw = (r.text or "").encode()
        assert (found[r.doc_id].size, found[r.doc_id].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert (found[r.doc_id].shard, found[r.doc_id].slot) == (int(r.shard), r.slot)
    plan = sharded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan  # the texts are shuffled once


def turns(spark, *rows):
    return spark.createDataFrame(rows, "pair_id bigint, turn bigint, role string, text string")


def test_common_prefix_is_rendered_once(spark):
    chosen = turns(spark, (1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "more"), (1, 3, "assistant", "good"))
    rejected = turns(spark, (1, 0, "user", "q"), (1, 1, "assistant", "same"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"),
                     (1, 4, "user", "why"))
    row = chat.preference_pairs(chosen, rejected).collect()[0]
    assert row.prompt == (
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nsame<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    )
    assert row.prompt_turns == 3
    assert row.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert row.rejected == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nwhy<|im_end|>\n"
    cut = lambda text, spans: [text[s.start : s.start + s.length] for s in spans]
    assert cut(row.chosen, row.chosen_spans) == ["good<|im_end|>\n"]
    assert cut(row.rejected, row.rejected_spans) == ["bad<|im_end|>\n"]


def test_chat_edge_cases(spark):
    chosen = turns(spark, (1, 0, "user", "q"), (2, 0, None, None), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, "user", "n"))
    rejected = turns(spark, (1, 0, "user", "q"), (3, 0, "user", "a"), (4, None, "assistant", "only"))
    rows = {r.pair_id: r for r in chat.preference_pairs(chosen, rejected).collect()}
    assert set(rows) == {1, 2, 3, 4, None}
    assert (rows[1].prompt_turns, rows[1].chosen, rows[1].rejected) == (1, "", "")
    assert rows[2].prompt == "" and rows[2].chosen == "<|im_start|>\n<|im_end|>\n" and rows[2].chosen_spans == []
    assert rows[3].prompt_turns == 1 and rows[3].rejected == "" and len(rows[3].chosen_spans) == 1
    assert rows[4].chosen == "" and len(rows[4].rejected_spans) == 1
    assert rows[None].rejected == ""
    assert chat.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_queries_match_their_sql(spark):
    duck = duckdb.connect()
    for name in ("conversations", "documents", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF_DIR)
        want = duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(repr, found.select(*names).collect())) != []
        rows = sorted(tuple(map(repr, r)) for r in found.select(*names).collect())
        assert rows == sorted(tuple(map(repr, r)) for r in want.fetchall())
        assert set(found.columns) == set(names)
