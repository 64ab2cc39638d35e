"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A document contains an item when it has at least ``threshold`` of the item's distinct shingles (``shingle_words`` words, lower
case; fewer words: the whole sequence).

1. Items are partitioned by the logarithm of their number of shingles. An item's sketch is its shingles of smallest hash, as many
   as its size class needs: more than the share of the class's largest item that a containing document may lack. A document
   without any shingle of the sketch lacks them all and cannot reach the threshold, so no containing document is lost.
2. Search: shingles of all documents are joined with the sketches, and with nothing else; what meets is a candidate.
3. Check: the candidate documents are read once more, and all their shingles are counted against all those of the very items they
   are candidates for. Two hashes (96 bits) tell shingles apart.

Rows of equal doc_id, or of equal item_id, count as one document or item; rows without a doc_id are told apart by their texts (64
bits of hash), equal ones count as one, and doc_id is null in the result; items without an item_id count as one. Nulls and texts
without words contain nothing and are not contained; empty tables give an empty result; extra columns are ignored. A text of any
length is one row, whose shingles are made in one task. Sketches, item shingles and candidate documents are broadcast only if they
are at most ``broadcast_rows``, else both sides are dealt out by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts, words

BROADCAST_ROWS = 1_000_000


def _shingles(texts: DataFrame, text_col: str, size: int) -> DataFrame:
    """The other columns of ``texts``, h, g: a row for each shingle and place."""
    keep = [c for c in texts.columns if c != text_col]
    d = texts.select(*keep, words(F.lower(text_col)).alias("_w")).where(F.size("_w") > 0)
    w = F.col("_w")
    at = F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))
    of = lambda i: [F.get(w, i + k) for k in range(size)]
    d = d.select(*keep, F.explode(F.transform(at, lambda i: F.struct(F.xxhash64(*of(i)).alias("h"), F.hash(*of(i)).alias("g")))).alias("_s"))
    return d.select(*keep, "_s.h", "_s.g")


def sketches(items: DataFrame, threshold: float, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, h, g, n_item, in_sketch): each distinct shingle of each item."""
    s = _shingles(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "text", shingle_words).distinct()
    own = Window.partitionBy("item_id")
    s = s.select("*", F.count("*").over(own).alias("n_item"), F.row_number().over(own.orderBy("h", "g")).alias("place"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1  # of the size class
    return s.select("item_id", "h", "g", "n_item", (F.col("place") <= F.floor(largest * (1 - threshold) + 1e-9) + 1).alias("in_sketch"))


def _small(d: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(d) if d.limit(rows + 1).count() <= rows else d


def candidates(docs: DataFrame, sketch: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, row, item_id): the documents (doc_id, row, text) that have a shingle of an item's sketch (item_id, h, g)."""
    met = _shingles(docs, "text", shingle_words).withColumnRenamed("g", "doc_g").join(sketch, "h").where("g = doc_g")
    return met.select("doc_id", "row", "item_id").distinct()


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each document and item contained in it."""
    cuts = Cuts(docs.sparkSession, "decontamination")
    every = cuts.cut(sketches(items, threshold, shingle_words, item_id, item_text))
    d = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0)).alias("row"), F.col(text_col).alias("text"))
    found = cuts.cut(candidates(d, _small(every.where("in_sketch").select("item_id", "h", "g"), broadcast_rows), shingle_words))
    wanted = found.groupBy("doc_id", "row").agg(F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("no_id"))
    of = [F.col(c).alias(f"of_{c}") for c in ("doc_id", "row")]
    wanted = _small(wanted.select(*of, "item_ids", "no_id"), broadcast_rows)
    again = d.join(wanted, d["doc_id"].eqNullSafe(F.col("of_doc_id")) & (F.col("row") == F.col("of_row"))).select("doc_id", "row", "item_ids", "no_id", "text")
    said = _shingles(again, "text", shingle_words).withColumnRenamed("g", "doc_g")
    asked: Column = F.when(F.col("item_id").isNull(), F.col("no_id")).otherwise(F.array_contains("item_ids", F.col("item_id")))
    said = said.join(_small(every.drop("in_sketch"), broadcast_rows), "h").where((F.col("g") == F.col("doc_g")) & asked)
    pairs = said.groupBy("doc_id", "row", "item_id", "h", "g").agg(F.first("n_item").alias("n_item"))
    pairs = pairs.groupBy("doc_id", "row", "item_id").agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
    pairs = pairs.where(F.col("n_shared") >= F.col("n_item") * F.lit(float(threshold)) - F.lit(1e-9))
    return pairs.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
