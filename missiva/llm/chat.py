r"""Operator 5, chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; adjacent turns of one role form one block,
found by comparing each turn with its neighbours in the sorted array; the blocks are written as

    <turn ROLE>TEXT<part>TEXT</turn>

Texts and roles are escaped so that no ``<`` is left in them: a backslash becomes ``\b`` and ``<`` becomes ``\l``, in roles also ``>`` becomes ``\g``. So
every ``<`` of the output begins a marker, and unescaping (``\b`` last) gives each text back exactly.

The output is an array of segments (text, loss); the formatted conversation is all segments' text, and the loss mask
covers the escaped text of the assistant's turns, without markers.

Defined results: a null text or role is empty; turns with equal numbers (and repeated rows) are all kept, ordered by
role and text, a null turn first; a null conv_id is a conversation of its own; an empty table gives an empty result;
extra columns are not read. A conversation is one row, as in the output, and meets in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, *, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted."""
    rows = turns.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("x"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def role(x: Column) -> Column:
        return F.replace(escape(x["role"]), F.lit(">"), F.lit("\\g"))

    def pieces(x: Column, i: Column) -> Column:
        opens = F.coalesce(F.get("x", i - 1)["role"] != x["role"], F.lit(True))
        closes = F.coalesce(F.get("x", i + 1)["role"] != x["role"], F.lit(True))
        before = F.when(opens, F.concat(F.lit("<turn "), role(x), F.lit(">"))).otherwise("<part>")
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")),
            F.struct(F.when(closes, F.lit("</turn>")).otherwise("").alias("text"), F.lit(False).alias("loss")),
        )

    out = chats.select("conv_id", F.flatten(F.transform("x", pieces)).alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""

    def turns_of(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, ">", 1), F.lit("\\g"), F.lit(">")))
        body = F.substring(block, F.length(F.substring_index(block, ">", 1)) + 2, F.length(block))
        texts = F.split(F.replace(body, F.lit("</turn>"), F.lit("")), "<part>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.substring(formatted, 7, F.length(formatted)), "<turn ", -1)
    return F.flatten(F.transform(blocks, turns_of))


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from format_chats' output."""
    read = chats.select(
        "conv_id",
        parse_chats(F.col("formatted")).alias("turns"),
        unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = (-7, "\\### Assistant: </turn> ok")

ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (
  SELECT *, length(text) + (length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS esc_chars,
         CASE WHEN before IS NULL OR before <> role
              THEN 7 + length(role) + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', ''))) ELSE 6 END
         + CASE WHEN after IS NULL OR after <> role THEN 7 ELSE 0 END AS marks
  FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc_chars + marks) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
