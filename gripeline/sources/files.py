"""Readers and writers with clear errors."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REPLIES

REPLY_COLUMNS = ("tweet_id", "in_response_to_tweet_id", "text")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of replies, all columns strings; columns are matched by header, quotes in a quoted text are doubled, and it may hold line breaks."""
    try:
        header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if missing := sorted(set(REPLY_COLUMNS) - set(header.columns)):
        raise ValueError(f"{path}: missing columns {missing}")
    names = [f.name for f in REPLIES]
    return header.select(*(F.col(c) if c in header.columns else F.lit(None).cast("string").alias(c) for c in names))


def read_taxonomy(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def write_taxonomy(pack: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(pack, f, indent=1, sort_keys=True)
