"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

Both sides are cut into turns numbered by their order. The longest common prefix of turns (same role and text) is
rendered once as the prompt; what follows on each side is that side's completion. A completion comes with the
spans of characters to train on: the assistant's words and the mark that ends its turn.

Defined results: a null role or text counts as empty text; turns with equal numbers are ordered by role and text,
a null turn number comes first; equal sides give empty completions; a side that is only a prefix of the other gets
an empty completion; a pair with one side only is rendered with an empty prompt; a null pair id is one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The markers of the rendered form.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _numbered(turns: DataFrame, side: str) -> DataFrame:
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    clean = turns.select(
        "pair_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return clean.select(
        "pair_id",
        F.row_number().over(order).alias("place"),
        F.lit(side).alias("side"),
        F.struct("role", "text").alias("said"),
    )


def _joined(part: str, value: str) -> Column:
    """The part's rendered turns in order, as one text."""
    listed = F.collect_list(F.when(F.col("part") == part, F.struct("place", value)))
    return F.array_join(F.transform(F.sort_array(listed), lambda x: x[value]), "")


def _spans(part: str) -> Column:
    """Trained spans of the part: (first character, length)."""
    trained = (F.col("part") == part) & F.col("trained")
    listed = F.sort_array(F.collect_list(F.when(trained, F.struct("start", "length"))))
    return listed.cast("array<struct<start:bigint,length:bigint>>")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per pair_id: prompt, prompt_turns, chosen, chosen_spans, rejected, rejected_spans.

    Both tables hold pair_id, turn, role and text; other columns are ignored.
    """
    rows = _numbered(chosen, "chosen").unionByName(_numbered(rejected, "rejected"))
    sides = rows.groupBy("pair_id", "place").agg(
        F.max(F.when(F.col("side") == "chosen", F.col("said"))).alias("chosen"),
        F.max(F.when(F.col("side") == "rejected", F.col("said"))).alias("rejected"),
    )
    whole = Window.partitionBy("pair_id")
    parting = F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))).over(whole)
    common = sides.withColumn("in_prompt", F.coalesce(F.col("place") < parting, F.lit(True)))
    entry = lambda part, side: F.struct(F.lit(part).alias("part"), F.col(side).alias("said"))
    parts = F.when(F.col("in_prompt"), F.array(entry("prompt", "chosen"))).otherwise(
        F.array(entry("chosen", "chosen"), entry("rejected", "rejected"))
    )
    turns = (
        common.select("pair_id", "place", F.explode(parts).alias("entry"))
        .select("pair_id", "place", "entry.part", "entry.said.role", "entry.said.text")
        .where(F.col("role").isNotNull())
        .withColumn("head", F.concat(F.lit(OPEN), "role", F.lit(BREAK)))
        .withColumn("body", F.concat("text", F.lit(CLOSE)))
        .withColumn("rendered", F.concat("head", "body"))
    )
    before = Window.partitionBy("pair_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select(
        "pair_id",
        "place",
        "part",
        "rendered",
        (F.col("role") == TRAINED_ROLE).alias("trained"),
        (F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)) + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    return placed.groupBy("pair_id").agg(
        _joined("prompt", "rendered").alias("prompt"),
        F.count_if(F.col("part") == "prompt").alias("prompt_turns"),
        _joined("chosen", "rendered").alias("chosen"),
        _spans("chosen").alias("chosen_spans"),
        _joined("rejected", "rendered").alias("rejected"),
        _spans("rejected").alias("rejected_spans"),
    )


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations.

    Chosen is the conversation. Rejected is the same one with its last assistant turn exchanged for that of the
    neighbour (ids 2k and 2k + 1 are neighbours). Without an assistant turn on both sides, nothing is exchanged.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = (
        turns.where(F.col("role") == TRAINED_ROLE)
        .groupBy("pair_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
        .where(F.col("pair_id").isNotNull())
    )
    swapped = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"))
    plan = answers.join(swapped, "pair_id").select("pair_id", F.col("last").alias("was"), "other")
    is_last = (F.col("role") == TRAINED_ROLE) & F.struct("turn", "text").eqNullSafe(F.col("was"))
    rejected = turns.join(plan, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text")
    )
    return turns, rejected
