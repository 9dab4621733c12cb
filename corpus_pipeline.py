"""The corpus pipeline: `documents` pass the stages in order, each written to Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), calls one operator on all rows that the one before kept, and puts its
decisions into effect. All but the last return the columns of `documents`; columns beyond these are passed on.

Rows with null or empty texts: they are not toxic, have no language and are dropped by that stage. An empty table
passes all stages and ends as an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import best_fit, langid, simhash, substring, toxicity
from postloom.llm.common import NULL_ID, table


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id the operator kept; rows of one doc_id share the fate of the strictest.

    decided: doc_id and `kept`. The join moves the texts once; nothing is sent to all executors.
    """
    key = F.coalesce("doc_id", F.lit(NULL_ID)).alias("__doc")
    dropped = decided.where(~F.col("kept")).select(key).distinct()
    return docs.select("*", key).join(dropped, "__doc", "left_anti").drop("__doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (6): documents that the machine predicts toxic go. It learns from the labels of `docs`."""
    labels = toxicity.learning_labels(table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return _kept(docs, scored.select("doc_id", (F.col("predicted") == 0).alias("kept")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (1): documents that fit no language's model, or hold no letter, go."""
    found = langid.identify(docs, langid.learn(langid.learning_rows(docs)))
    return _kept(docs, found.select("doc_id", (~F.col("rejected")).alias("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (2): of each group of near copies the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (8): words of passages that start earlier elsewhere go; n_chars follows the text.

    A text without repeats stays as it is; one that loses words is its other words joined by one space.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring.deduplicated(docs, carry=others)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (3): pieces of at most 2,048 tokens with their sequence and place."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return best_fit.pack(best_fit.cut(docs, vocabulary))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: No stage can be expressed in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; the tables between them lie in the warehouse folder."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
