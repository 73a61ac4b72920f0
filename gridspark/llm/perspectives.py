"""Multi-party chat formatting: one training dialogue for each participant.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all other
speakers as named users and system turns as system, and only the assistant's words (with their end mark) bear loss.

The result has a row for each message of each dialogue, with its place in the rendered dialogue, so a dialogue
of any length is never gathered in one task: the running position is a two-level sum, over blocks of
``block_turns`` turns and then inside each block. Messages without a turn number, and those of blocks of over ``crowd``
messages, are in blocks of one turn, one speaker and the ``PREFIX`` characters that they begin with. Texts are shuffled once, by block, before they are repeated for each
participant; what is summed for blocks and participants is numbers. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import broadcast_if_small, table

START, END = "<|im_start|>", "<|im_end|>"
#: Characters by which messages of one turn, or of none, are dealt to blocks; any number gives the same result.
PREFIX = 8


def _plain(text: Column) -> Column:
    """Text in which no marker can be forged."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


#: What a name must not hold, and how it is written instead; '%' first, so that no two names become one.
ESCAPES = [("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ("=", "%3D")]


def named(speaker: Column) -> Column:
    """A name on one line, without a space or a marker, from which the speaker can be told."""
    for plain, escaped in ESCAPES:
        speaker = F.replace(speaker, F.lit(plain), F.lit(escaped))
    return speaker


def _head(role: Column, name: Column | None = None) -> Column:
    """What stands before a message; without a name where it is null."""
    said = F.lit("") if name is None else F.coalesce(F.concat(F.lit(" name="), name), F.lit(""))
    return F.concat(F.lit(START), role, said, F.lit("\n"))


def _size(head: Column) -> Column:
    """Characters of a rendered message."""
    return (F.length(head) + F.length("body") + F.lit(len(END) + 1)).cast("long")


def rotate(turns: DataFrame, block_turns: int = 256, crowd: int = 4096) -> DataFrame:
    """Rows conv_id, perspective, seq, turn, role, name, content, char_start, loss_start, loss_end.

    ``turns`` has conv_id, turn, role (the speaker; 'system' takes no perspective) and text. Messages go by turn,
    nulls first, then by speaker and text; ``seq`` counts them from 0. ``content`` is the rendered message;
    char_start is its place in the dialogue, and loss_start to loss_end (null unless the assistant speaks) is
    the masked-in stretch, all in characters of the dialogue. Different speakers have different names, in which what
    could break the header is escaped. A null text is empty, a null role is the speaker
    'unknown', a null conv_id is a conversation of its own. Repeated rows are repeated messages. A conversation
    with system turns only has no perspective and gives no row, as does an empty table. Other columns are not read.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), _plain(F.col("text")).alias("body")
    )
    # rises, in a conversation, with the order of the messages: turn, nulls first, then speaker and text
    rows = rows.withColumn("_turns", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    # blocks of many messages, as when many have one turn number; rarely there are any
    crowds = turns.groupBy("conv_id", F.floor(F.col("turn").cast("long") / block_turns).alias("_of")).count().where(F.col("_of").isNotNull() & (F.col("count") > crowd))
    crowds = crowds.select(F.struct("conv_id").alias("_in"), "_of")
    rows = rows.join(broadcast_if_small(crowds), (F.struct("conv_id") == F.col("_in")) & (F.col("_turns") == F.col("_of")), "left")
    loose = F.col("turn").isNull() | F.col("_of").isNotNull()
    block = [
        F.col("_turns").alias("turns"),
        F.when(loose, F.coalesce("turn", F.lit(0))).otherwise(0).alias("turn"),
        F.when(loose, F.col("speaker")).otherwise("").alias("speaker"),
        F.when(loose, F.substring("body", 1, PREFIX)).otherwise("").alias("begins"),
    ]
    rows = rows.withColumn("_key", F.struct("conv_id", *block)).drop("_turns", "_in", "_of")  # structs are equal where nulls meet nulls
    person, conversation = F.col("speaker") != "system", F.struct(F.col("_key.conv_id")).alias("_conv")

    # where every block begins in every dialogue; an assistant's messages differ from a user's by their heads only
    heard = _head(F.when(person, "user").otherwise("system"), F.when(person, named(F.col("speaker"))))
    parts = rows.groupBy("_key", "speaker").agg(F.sum(_size(heard)).alias("_chars"), F.count(F.lit(1)).alias("_n"))
    blocks = parts.groupBy("_key").agg(F.sum("_chars").alias("_chars"), F.sum("_n").alias("_n")).withColumn("_conv", conversation)
    people = parts.where(person).select(conversation, F.col("speaker").alias("perspective")).distinct()
    own = parts.where(person).select("_key", F.col("speaker").alias("perspective"), F.col("_n").alias("_own"))
    longer = F.length(_head(F.lit("assistant"))) - F.length(_head(F.lit("user"), named(F.col("perspective"))))
    chars = F.col("_chars") + F.coalesce("_own", F.lit(0)) * longer
    before = Window.partitionBy("_conv", "perspective").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.join(people, "_conv").join(own, ["_key", "perspective"], "left").select(
        "_key", "perspective", F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("_chars"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n")
    )

    # messages meet the dialogues block by block, and stay where that join has put them
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(~person, "system").when(mine, "assistant").otherwise("user")
    name = F.when(role == "user", named(F.col("speaker")))
    made = rows.join(starts, "_key").withColumns({"role": role, "name": name}).withColumn("head", _head(F.col("role"), F.col("name")))
    inside = Window.partitionBy("_key", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body")
    above = F.sum(_size(F.col("head"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = made.select(
        "*",
        (F.row_number().over(inside) - 1 + F.col("_n")).cast("long").alias("seq"),
        (F.coalesce(above, F.lit(0)) + F.col("_chars")).alias("char_start"),
    )
    spoken = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "seq", "turn", "role", "name",
        F.concat("head", "body", F.lit(END + "\n")).alias("content"),
        "char_start",
        F.when(spoken, F.col("char_start") + F.length("head")).alias("loss_start"),
        F.when(spoken, F.col("char_start") + _size(F.col("head")) - 1).alias("loss_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


_NAME = "speaker"
for _plain_part, _escaped in ESCAPES:
    _NAME = f"replace({_NAME}, chr({ord(_plain_part)}), '{_escaped}')"

ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT t.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), n AS (
  SELECT *, CASE WHEN role = 'user' THEN {_NAME} END AS name FROM r
), h AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM n
), c AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS content FROM h
), o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    coalesce(sum(length(content)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
  FROM c WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body)
)
SELECT conv_id, perspective, seq, turn, role, name, content, char_start,
  CASE WHEN role = 'assistant' THEN char_start + length(head) END AS loss_start,
  CASE WHEN role = 'assistant' THEN char_start + length(content) - 1 END AS loss_end
FROM o
"""
