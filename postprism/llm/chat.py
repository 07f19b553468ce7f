"""Conversations as training text with a loss mask, with Spark expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's own control strings, and those of other templates that a text must not pass for either.
BLOCK, TEXT, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"
CONTROLS = (BLOCK, TEXT, PART, END, "<s>", "</s>", "[INST]", "[/INST]")

# A control string's first character, any backslashes, and ahead the rest of the string. No rest holds a first
# character, so escapes do not touch each other.
_REST = "(?=" + "|".join(re.escape(control[1:]) for control in CONTROLS) + ")"


def escape(text: Column) -> Column:
    """One more backslash inside everything that is, but for backslashes, a control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2")


def format_chats(
    rows: DataFrame, learned: str = "assistant", conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conversation, formatted, loss_runs)``: one training text for each conversation and where it is learned.

    Turns are sorted by number, then role and text; neighbours of one role share a block:
    ``<|im_start|>role<|im_sep|>text<|im_part|>next text<|im_end|>``. Roles and texts are escaped, so the output can be
    read back turn by turn. ``loss_runs`` is the loss mask as run lengths, one ``(skip, chars, learned)`` for each text in order: so many
    characters of ``formatted`` that are not learned, then so many that are (0 where the text is not learned). Neither markers
    nor other roles are learned. Everything is linear in the number of turns. NULL roles and texts are empty, a NULL turn comes first, rows without a
    conversation are one conversation, repeated rows are turns of their own. No rows give no conversation.
    """
    plain = rows.select(
        F.col(conversation).cast("long").alias("conversation"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
        ).alias("row"),
    )
    turns = plain.groupBy("conversation").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def piece(row: Column, at: Column) -> Column:
        before, after = F.get("turns", at - 1), F.get("turns", at + 1)
        opens = (at == 0) | (before["role"] != row["role"])
        closes = after.isNull() | (after["role"] != row["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(BLOCK), row["role"], F.lit(TEXT))).otherwise(F.lit(PART)).alias("head"),
            row["text"].alias("text"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (row["role"] == escape(F.lit(learned))).alias("learned"),
        )

    def run(own: Column, at: Column) -> Column:
        before = F.when(at > 0, F.length(F.get("pieces", at - 1)["tail"])).otherwise(0)
        size = F.length(own["text"])
        skip = before + F.length(own["head"]) + F.when(own["learned"], 0).otherwise(size)
        return F.struct(skip.alias("skip"), F.when(own["learned"], size).otherwise(0).alias("chars"), own["learned"].alias("learned"))

    pieces = turns.select("conversation", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        F.col("conversation").alias(conversation),
        F.array_join(F.transform("pieces", lambda own: F.concat(own["head"], own["text"], own["tail"])), "").alias("formatted"),
        F.transform("pieces", run).alias("loss_runs"),
    )


def _blocks(formatted: Column) -> Column:
    blocks = F.split(formatted, re.escape(BLOCK), -1)
    return F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))


def _texts(block: Column) -> Column:
    """The texts of a block as they are written."""
    return F.split(F.substring_index(F.substring_index(block, TEXT, -1), END, 1), re.escape(PART), -1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``."""

    def of_block(block: Column) -> Column:
        role = unescape(F.substring_index(block, TEXT, 1))
        return F.transform(_texts(block), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(_blocks(formatted), of_block))


def read_learned(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array.

    Texts are cut at the markers, once for all, and meet their runs in order: cutting each out of the whole by its place would read
    the conversation again for every text.
    """
    texts = F.flatten(F.transform(_blocks(formatted), _texts))
    learned = F.zip_with(texts, runs, lambda text, run: F.when(run["learned"], unescape(F.substring(text, F.lit(1), run["chars"]))))
    return F.filter(learned, lambda text: text.isNotNull())
