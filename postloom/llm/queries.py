"""The registered queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (
    best_fit,
    byte_bpe,
    chat,
    hard_negatives,
    hnsw,
    langid,
    phrases,
    sharding,
    simhash,
    substring,
    toxicity,
    va_file,
    warc,
)
from postloom.llm.common import id_crc, shared_folder, table

SHARDS = 24


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(langid.learning_rows(docs)))
    return found.withColumn("held_out", F.pmod(id_crc("doc_id"), F.lit(4)) == 2)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"))
    found = simhash.near_duplicates(prints, simhash.band_pairs(simhash.RADIUS))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")  # byte_bpe_50k.json as ranks
    return best_fit.pack(best_fit.cut(table(spark, sf_dir, "documents"), vocabulary))


def op4_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(*chat.swapped_answers(table(spark, sf_dir, "conversations")))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))), ","
    )
    return pairs.withColumns({"chosen_spans": text("chosen_spans"), "rejected_spans": text("rejected_spans")})


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, toxicity.learning_labels(labels)))
    return scored.withColumn("held_out", F.pmod(id_crc("doc_id"), F.lit(3)) == 1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents are shuffled and written as shards; the digests are those of the texts in the shards."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.shard(table(spark, sf_dir, "documents"), size, SHARDS), path, files_per_shard=None)
    stored = spark.read.schema("doc_id bigint, text string, slot bigint, shard int").parquet(path)
    return stored.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot").withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.highest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), label, every=50, positives=5, negatives=3)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_simhash,
        op3_best_fit_packing,
        op4_preference_chat,
        op5_byte_bpe,
        op6_toxicity,
        op7_sharding,
        op8_substring_dedup,
        op9_hnsw,
        op10_va_file,
        op11_warc,
        op12_hard_negatives,
        op13_phrases,
    )
}

_NUMBERED = """SELECT pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM """


def _part(part: str, side: str, where: str) -> str:
    return f"""SELECT pair_id, place, '{part}' AS part, {side}.role AS role, {side}.text AS text
               FROM sides JOIN parting USING (pair_id) WHERE {where} AND {side} IS NOT NULL"""


def _joined(part: str) -> str:
    return f"coalesce(string_agg(head || body, '' ORDER BY place) FILTER (part = '{part}'), '')"


def _spans(part: str) -> str:
    span = "first || '+' || length(body)"
    return f"""coalesce(string_agg({span}, ',' ORDER BY first)
               FILTER (part = '{part}' AND role = '{chat.TRAINED_ROLE}'), '')"""


_PREFERENCE = f"""
WITH turns AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
answers AS (
    SELECT pair_id, max(struct_pack(turn, text)) AS was FROM turns
    WHERE role = '{chat.TRAINED_ROLE}' AND pair_id IS NOT NULL GROUP BY pair_id
),
swaps AS (SELECT a.pair_id, a.was, b.was.text AS other FROM answers a JOIN answers b ON b.pair_id = xor(a.pair_id, 1)),
swapped AS (
    SELECT pair_id, turn, role, CASE WHEN role = '{chat.TRAINED_ROLE}' AND swaps.was IS NOT NULL
               AND struct_pack(turn := turns.turn, text := turns.text) IS NOT DISTINCT FROM swaps.was
           THEN other ELSE text END AS text
    FROM turns LEFT JOIN swaps USING (pair_id)
),
sides AS (
    SELECT pair_id, place, c.said AS chosen, r.said AS rejected
    FROM (SELECT pair_id, place, struct_pack(role, text) AS said FROM ({_NUMBERED} turns)) c
    FULL JOIN (SELECT pair_id, place, struct_pack(role, text) AS said FROM ({_NUMBERED} swapped)) r USING (pair_id, place)
),
parting AS (
    SELECT pair_id, coalesce(min(CASE WHEN chosen IS DISTINCT FROM rejected THEN place END), 1000000000000) AS cut
    FROM sides GROUP BY pair_id
),
parts AS (
    {_part("prompt", "chosen", "place < cut")}
    UNION ALL {_part("chosen", "chosen", "place >= cut")}
    UNION ALL {_part("rejected", "rejected", "place >= cut")}
),
rendered AS (
    SELECT *, '{chat.OPEN}' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body FROM parts
),
placed AS (
    SELECT *, CAST(length(head) + coalesce(sum(length(head || body)) OVER (PARTITION BY pair_id, part ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
    FROM rendered
)
SELECT pair_id, {_joined("prompt")} AS prompt, count(*) FILTER (part = 'prompt') AS prompt_turns,
       {_joined("chosen")} AS chosen, {_spans("chosen")} AS chosen_spans,
       {_joined("rejected")} AS rejected, {_spans("rejected")} AS rejected_spans
FROM placed GROUP BY pair_id"""

_SUBSTRING = f"""
WITH split AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
),
starts AS (
    SELECT doc_id, start, md5(array_to_string(words[start : start + {substring.WINDOW - 1}], ' ')) AS key
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {substring.WINDOW - 2})) AS start FROM split
          WHERE len(words) >= {substring.WINDOW})
),
firsts AS (SELECT key, min(struct_pack(doc_id, start)) AS first FROM starts GROUP BY key HAVING count(*) > 1),
ranked AS (
    SELECT doc_id, start, 1 + CAST(struct_pack(doc_id, start) <> first AS INTEGER) AS nth FROM starts JOIN firsts USING (key)
),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + {substring.WINDOW})) AS place FROM ranked WHERE nth > 1
),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM placed ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

_INNER_PRODUCTS = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS point FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.point, c.point) AS BIGINT) AS score
        FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.point) = len(q.point) WHERE q.vec_id % 50 = 0
    )
) WHERE nth <= 5"""

_DIGITS = "instr('0123456789abcdef', substr(hex, 5 * (i // 4) + {k}, 1)) - 1"
_FIVE_BITS = " + ".join(f"({_DIGITS.format(k=k)}) * {16 ** (5 - k)}" for k in range(1, 6))
_CAPTURES = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digested AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + (({_FIVE_BITS}) // power(32, 3 - i % 4)::BIGINT) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digested"""

_NEGATIVES = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS point FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
           CAST(list_dot_product(a.point, b.point) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.point) = len(b.point) WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
           ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""

_PHRASES = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'
    )), '[^\x20\x09]+') AS words FROM documents
),
starts AS (SELECT lang, words[i : i + 3] AS words FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces)),
counts AS (
    SELECT lang, size, words[1 : size] AS phrase, count(*) AS f
    FROM starts, (VALUES (1), (2), (3), (4)) sizes(size) WHERE len(words) >= size GROUP BY ALL
),
candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, CAST(c.f AS HUGEINT) * 2000000 // (l.f + r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS cut FROM candidates) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1 : cut]
    JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[cut + 1 : c.size]
),
lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
inside AS (
    SELECT lang, phrase[i : i + n - 1] AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(1, size)) AS i FROM candidates), (VALUES (2), (3)) lengths(n)
    WHERE n < size AND i + n - 1 <= size GROUP BY ALL
),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
spelled AS (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score
    FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM spelled JOIN totals USING (lang) QUALIFY rank <= 2000"""

#: The other queries are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_preference_chat": _PREFERENCE,
    "op8_substring_dedup": _SUBSTRING,
    "op10_va_file": _INNER_PRODUCTS,
    "op11_warc": _CAPTURES,
    "op12_hard_negatives": _NEGATIVES,
    "op13_phrases": _PHRASES,
}
