"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once: that speaker's turns as the
assistant, everybody else's as a user with the speaker's name, system turns as they are. What is to be
learned (the speaker's own text and its end mark) is marked by its character span within the rendering.

A rendering is a sequence of rows, one for each turn, with gapless character offsets. It is never one
string, so a conversation of any length is spread over tasks: offsets are summed in blocks of
``block_turns`` turn numbers, the blocks' totals (a small fraction of the rows) are summed over the
conversation, and both are added.

Defined results: null text is empty; a null role speaks as ``unknown``; rows without conv_id belong to no
dialogue and are left out; null turns come last; turns that tie are ordered by role and text, repeated rows
are all rendered; a conversation of system turns only has no participant and no rows. Marks inside a text
are broken up, so that a text can't open a turn. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_LAST_TURN = 2**62


def _turns(conversations: DataFrame, block_turns: int) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(_LAST_TURN))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        turn.alias("turn_at"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("speaker"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
        F.floor(turn / block_turns).cast("long").alias("block"),
    )


def _name(speaker: str) -> Column:
    return F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")


def rotate_perspectives(conversations: DataFrame, block_turns: int = 256) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, end, mask_start, mask_end.

    A rendering is the segments of a (conv_id, perspective) in the order of start; mask_start and mask_end
    are null where nothing is learned.
    """
    turns = _turns(conversations, block_turns)
    participants = (
        turns.filter("speaker != 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker") == "system", F.lit("system"))
        .when(own, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), _name("speaker")))
    )
    rendered = turns.join(participants, "conv_id").select(
        "conv_id",
        "perspective",
        "block",
        "turn_at",
        "turn",
        "speaker",
        "said",
        own.alias("own"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
    )
    rendered = rendered.withColumn("segment", F.concat("head", "said", F.lit(CLOSE + "\n"))).withColumn(
        "size", F.length("segment").cast("long")
    )
    totals = rendered.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("block_size"))
    dialogue = Window.partitionBy("conv_id", "perspective")
    before = totals.select(
        "conv_id",
        "perspective",
        "block",
        (F.sum("block_size").over(dialogue.orderBy("block")) - F.col("block_size")).alias("block_start"),
    )
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn_at", "speaker", "said")
    summed = rendered.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.col("block_start") + F.col("upto")
    start = end - F.col("size")
    learned = start + F.length("head")
    return summed.join(before, ["conv_id", "perspective", "block"]).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        end.alias("end"),
        F.when(F.col("own"), learned).alias("mask_start"),
        F.when(F.col("own"), end - 1).alias("mask_end"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(turn, 4611686018427387904) AS turn_at, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
participants AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
rendered AS (
  SELECT conv_id, perspective, turn, turn_at, speaker, said, speaker = perspective AS own,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
           ELSE 'user name=' || regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') END || chr(10) AS head
  FROM turns JOIN participants USING (conv_id)),
sized AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM rendered),
summed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn_at, speaker, said
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM sized)
SELECT conv_id, perspective, turn, speaker, segment, "end" - length(segment) AS start, "end",
       CASE WHEN own THEN "end" - length(segment) + length(head) END AS mask_start,
       CASE WHEN own THEN "end" - 1 END AS mask_end
FROM summed
"""
