"""Operator 1: chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by turn (ties by role, then text). Adjacent turns of one role share
a header. The output of a conversation is the array ``segments``: pieces of the formatted text in order, each with its role in
the loss; ``formatted`` is their concatenation.

    ### user:
    first text<part>second text</turn>
    ### assistant:
    answer</turn>

Inside texts and roles a backslash, ``</turn>``, ``<part>`` and ``###`` are escaped by a backslash, in roles line breaks too, so
that ``read_turns`` gives back the very turns. Null roles and texts count as empty; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives none. Extra columns are ignored. A conversation is one row of the output and is
put together in one task, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TURN, PART = "### ", "</turn>\n", "<part>"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), (PART, "<\\part>"), ("###", "\\###")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>): one row a conversation; the loss mask is the segments with loss true."""
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    head = lambda x: F.concat(F.lit(HEAD), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\\n")), F.lit(":\n"))
    before = lambda x, i: (
        F.when(i == 0, head(x)).when(F.get(t, i - 1)["role"] == x["role"], F.lit(PART)).otherwise(F.concat(F.lit(TURN), head(x)))
    )
    pair = lambda x, i: F.array(
        F.struct(before(x, i).alias("text"), F.lit(False).alias("loss")), F.struct(escape(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"))
    )
    d = d.select("conv_id", F.concat(F.flatten(F.transform(t, pair)), F.array(F.struct(F.lit(TURN).alias("text"), F.lit(False).alias("loss")))).alias("segments"))
    return d.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that were formatted."""
    blocks = F.split(formatted, TURN)
    of_block = lambda b: F.transform(
        F.split(F.element_at(F.split(b, ":\n", 2), 2), PART),
        lambda p: F.struct(unescape(F.substr(F.element_at(F.split(b, ":\n", 2), 1), F.lit(len(HEAD) + 1))).alias("role"), unescape(p).alias("text")),
    )
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of_block))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
