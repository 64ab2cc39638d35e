"""Tagging by a language model, in batches: prompts are made, replies read and repaired by columns; only the call itself is Python.

Conversations are numbered within parts of bounded size (by a hash of the id), so a batch has ``size`` of them at most whatever the
table's size and no task sees more than a part. A reply is JSON, perhaps within a code fence: an object with ``tags``, or the list itself. It is
parsed once, as a variant, and typed fields are taken from that. A conversation that a readable reply leaves out gets the
fallback tag; a reply that cannot be read leaves its whole batch out, which ``tag_conversations`` then gives the fallback tag without
caching it. Of several tags of one conversation in a reply the last counts; tags of conversations of other batches are not taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SIGNALS
from .taxonomy import Pack

#: Conversations to a batch for a model on this machine and behind an interface, and rows of a part.
LOCAL_BATCH, REMOTE_BATCH, PART_ROWS = 10, 25, 20_000
PROMPT_LEAVES, PROMPT_CHARS = 50, 200
_ITEMS = "array<struct<conversation_id:string,text:string>>"


class Model(Protocol):
    """Turns (batch, items, prompt) into (batch, reply); a null reply is a failed call."""

    def ask(self, prompts: DataFrame) -> DataFrame: ...


class ArrowModel:
    """Calls a function on lists of prompts, one list an Arrow batch; a call that raises makes its replies null."""

    def __init__(self, call: Callable[[list[str]], list[str | None]]):
        self.call = call

    def ask(self, prompts: DataFrame) -> DataFrame:
        call = self.call

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                try:
                    replies = call(b.column("prompt").to_pylist())
                except Exception:  # the model's failure, whatever it is: these batches get the fallback tag
                    replies = [None] * b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("batch"), pa.array(replies, pa.string())], names=["batch", "reply"])

        return prompts.select("batch", "prompt").mapInArrow(run, "batch long, reply string")


def batches(conversations: DataFrame, size: int) -> DataFrame:
    """(batch, items): conversations in batches of ``size`` at most, in order of their ids within a part."""
    n_parts = max(1, -(-conversations.count() // PART_ROWS))
    part = (F.conv(F.substring(F.md5(F.col("conversation_id").cast("binary")), 1, 8), 16, 10).cast("long") % n_parts).alias("part")
    d = conversations.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.coalesce("text", F.lit("")).alias("text"), part)
    place = F.row_number().over(Window.partitionBy("part").orderBy("conversation_id", "text")) - 1
    d = d.withColumn("place", place).withColumn("batch", F.shiftleft(F.col("part"), 32) + F.floor(F.col("place") / size))
    rows = F.array_sort(F.collect_list(F.struct("place", "conversation_id", "text")))
    return d.groupBy("batch").agg(F.transform(rows, lambda x: F.struct(x["conversation_id"].alias("conversation_id"), x["text"].alias("text"))).alias("items"))


def prompt(pack: Pack) -> Column:
    """What the model is asked about the column ``items``."""
    leaves = "\n".join(f"- {i}: {n.get('definition') or i}" for i, n in list(pack.nodes.items())[:PROMPT_LEAVES])
    fields = ", ".join(f'"{s}": 0 or 1' for s in SIGNALS)
    head = (
        f"Tag each support conversation below. Choose l5_id from these leaves:\n{leaves}\n\n"
        f'Answer with JSON only: {{"tags": [{{"conversation_id": ..., "l5_id": ..., "sentiment": "very_neg", "neg", "neutral" or "pos", {fields}, "confidence": 0 to 1}}]}}, '
        "one entry a conversation, in this order.\n\n"
    )
    lines = F.transform("items", lambda x: F.concat(F.lit("["), x["conversation_id"], F.lit("] "), F.substring(x["text"], 1, PROMPT_CHARS)))
    return F.concat(F.lit(head), F.array_join(lines, "\n"))


def read_reply(reply: Column) -> Column:
    """The tags of a reply as an array of variants; null if it cannot be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"\A```(json)?", ""), r"```\z", "")
    v = F.try_parse_json(F.trim(bare))
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(
        kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(v, "$.tags", "array<variant>"), F.array().cast("array<variant>"))
    ).when(v.isNotNull(), F.array().cast("array<variant>"))


class ModelTagger:
    """A ``Tagger`` that asks a model."""

    def __init__(self, model: Model, size: int = REMOTE_BATCH):
        self.model, self.size = model, size

    def tag(self, conversations: DataFrame, pack: Pack) -> DataFrame:
        asked = batches(conversations, self.size)
        replies = self.model.ask(asked.withColumn("prompt", prompt(pack))).select("batch", read_reply(F.col("reply")).alias("tags")).where("tags is not null")
        said = replies.select("batch", F.posexplode("tags").alias("n", "t"))
        field = lambda name, kind: F.try_variant_get("t", f"$.{name}", kind).alias(name)
        said = said.select("batch", "n", field("conversation_id", "string"), field("l5_id", "string"), field("sentiment", "string"), *(field(s, "int") for s in SIGNALS), field("confidence", "double"))
        names = ("l5_id", "sentiment", *SIGNALS, "confidence")
        said = said.where("conversation_id is not null").groupBy("batch", "conversation_id").agg(F.max_by(F.struct(*names), "n").alias("t"))
        rows = asked.select("batch", F.explode("items").alias("x")).select("batch", "x.conversation_id").distinct().join(replies.select("batch"), "batch")
        d = rows.join(said, ["batch", "conversation_id"], "left")
        there = F.col("t").isNotNull()
        return d.select(
            "conversation_id", F.when(there, F.coalesce(F.col("t.l5_id"), F.lit(""))).otherwise(F.lit(pack.ids()[0])).alias("raw_l5"),
            F.when(there, F.coalesce(F.col("t.sentiment"), F.lit("neg"))).otherwise(F.lit("neg")).alias("sentiment"),
            *(F.when(there, F.coalesce(F.col("t")[s], F.lit(0))).otherwise(F.lit(int(s == "unresolved"))).alias(s) for s in SIGNALS),
            F.when(there, F.coalesce(F.col("t.confidence"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        )
