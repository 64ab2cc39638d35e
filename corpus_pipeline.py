"""A corpus pipeline of five stages over ``documents``: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents`` with the text as it then is and n_chars counted anew. ``run`` writes each stage as Parquet to the shared folder and
reads it back for the next one.

What each stage does with odd rows: ids may be null or equal, and no stage drops a row for its id alone; null and empty texts fail
the quality rules, and later stages, given such texts, keep one of them (near-duplicates), drop them (passages: nothing is left),
or pass them on (leaks, tokens); repeated rows are one after the near-duplicates; an empty table passes through; columns other than
those of ``documents`` are dropped. Order by id decides ties, rows without one coming last, and then order by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gripeline.llm import bpe, decontamination, quality, simhash, units
from gripeline.llm.shared import Cuts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that failed are gone from the others."""
    return _with_text(quality.judge(docs.select(*COLUMNS)).where("kept"), "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles, the smallest id stays.

    Rows without an id come after all others, and of equal ids the smaller hash of the text comes first. Rows are told apart by
    id and text: rows of equal id, or without one, stay unless their own text belongs to a group with an earlier row.
    """
    id_, row = simhash.row_key()
    rows = docs.select(id_.alias("_id"), row.alias("_row"), F.struct("text", "lang", "source", "n_chars", "doc_id").alias("_r"))
    rows = rows.groupBy("_id", "_row").agg(F.min("_r").alias("_r"))  # repeated rows meet map-side, however many there are
    first = simhash.first_of_similar(docs, similarity=0.8, shingle_words=5).select(F.col("id").alias("_id"), F.col("row").alias("_row"))
    return rows.join(first, ["_id", "_row"], "left_semi").select(*(F.col("_r")[c].alias(c) for c in COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has are cut out; documents of which nothing is left go."""
    left = units.remove_repeated_units(docs.select(*COLUMNS))
    return _with_text(left.where(F.rlike("kept_text", F.lit(r"[^\x20\x09-\x0D]"))), "kept_text")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, each by its own text (told apart by 64 bits of hash), whatever its id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_row"))
    leaks = Cuts(spark, "leaks").cut(decontamination.contained_items(rows, items, id_col="_row").select(F.col("doc_id").alias("_row")).distinct())
    if leaks.limit(decontamination.BROADCAST_ROWS + 1).count() <= decontamination.BROADCAST_ROWS:
        leaks = F.broadcast(leaks)  # no text is shuffled then
    return rows.join(leaks, "_row", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    done = bpe.decode(bpe.encode(docs.select(*COLUMNS)))
    same = F.col("decoded_text") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Chains of similar texts and merges of tokens are beyond SQL; tests/llm/plain.py holds a brute-force version of every stage but
#: the last, which is tested against the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    cuts = Cuts(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = cuts.cut(stage(spark, docs, sf_dir))
        if i:
            cuts.drop(docs)
        docs = done
    return docs
