"""Conversations from replies: text cleaning, thread roots, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import folders
from ..functions.text import clean


def reply_time(col: Column) -> Column:
    """Timestamps like ``Tue Oct 31 22:10:47 +0000 2017`` or ISO; null if neither."""
    return F.coalesce(F.try_to_timestamp(F.substring(col, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(col))


def thread_roots(replies: DataFrame, cut=None, max_rounds: int = 64) -> DataFrame:
    """(id, root): the topmost ancestor present, by pointer doubling; in a cycle the smallest id of it.

    ``replies`` is (id, parent). Each round doubles the distance that pointers span, so a thread of n replies takes log n
    joins. Every round some reply of an unfinished thread reaches its root, so what still moves once neither the number of
    moving pointers nor a smallest id changes are cycles. ``cut`` writes a round's table to the shared
    folder and reads it back; by default a checkpoint, so that no round plans the ones before it.
    """
    cut = cut or folders.cut
    known = replies.select("id", "parent").dropDuplicates(["id"])
    present = known.select(F.col("id").alias("parent"), F.lit(True).alias("here"))
    start = known.join(present, "parent", "left").select("id", F.when(F.col("here"), F.col("parent")).otherwise(F.col("id")).alias("up"))
    ptr = cut(start.select("id", "up", F.least("id", "up").alias("low")))
    moved = None
    for _ in range(max_rounds):
        above = ptr.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        low = F.least("low", "low2")
        new = cut(ptr.join(above, "up").select("id", F.col("up2").alias("up"), low.alias("low"), (F.col("up2") != F.col("up")).alias("m"), (low != F.col("low")).alias("c")))
        n = new.agg(F.count_if("m").alias("moved"), F.count_if("c").alias("changed")).first()
        ptr = new.drop("m", "c")
        if not n["moved"] or (n["moved"] == moved and not n["changed"]):
            break
        moved = n["moved"]
    top = start.where("id = up").select(F.col("id").alias("up"), F.lit(True).alias("top"))
    return ptr.join(top, "up", "left").select("id", F.when(F.col("top"), F.col("up")).otherwise(F.col("low")).alias("root"))


def assemble(replies: DataFrame, roots: DataFrame) -> DataFrame:
    """(conversation_id, created_at, text): the earliest time and the cleaned texts, in order of time and id, joined by bars.

    ``replies`` is (id, created_at, text). A conversation is one row, so its texts meet in one task.
    """
    d = replies.join(roots, "id").select(F.col("root").alias("conversation_id"), "created_at", "id", clean(F.col("text")).alias("text"))
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("created_at", "id", "text"))))
    return d.groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.array_join(F.transform(said, lambda x: x["text"]), " | ").alias("text"))


def exact_sample(df: DataFrame, n: int, key: str = "conversation_id", seed: int = 42) -> DataFrame:
    """Exactly n rows (all if fewer), the same ones however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def batch_slice(df: DataFrame, batch: int, size: int = 50_000, key: str = "conversation_id") -> DataFrame:
    """The rows of the batch-th slice of ``size`` rows in the order of ``key``; batches count from 1.

    Keys are range-partitioned and counted by partition, so that no task sees more than its range. The ranged table is written
    once, so that counts and rows come of the same ranges.
    """
    d = folders.cut(df.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    before = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(key)) + F.col("_before")
    return d.join(F.broadcast(before), "_p").withColumn("_nth", nth).where(F.col("_nth").between((batch - 1) * size + 1, batch * size)).drop("_p", "_n", "_before", "_nth")
