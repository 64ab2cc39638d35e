"""Search of exemplars by an inverted index that is kept beside the graph.

The index of a version is one table of postings (term, id, l5_id, severity, tf, length), bucketed and sorted by term, and one row of
totals. It is written by ``build_index`` once its version is there and never changed. A search reads the postings of its terms only:
the filter on ``term`` prunes buckets, and within them row groups. Scores are BM25 over all snippets of the version.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import reads
from .graph import Store

POSTING = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("id", T.StringType()), T.StructField("l5_id", T.StringType()), T.StructField("severity", T.DoubleType()),
    T.StructField("tf", T.LongType()), T.StructField("length", T.LongType()),
])
TOTALS = "n long, words long"
K1, B = 1.5, 0.75


def postings(exemplars: DataFrame) -> DataFrame:
    """(term, id, l5_id, severity, tf, length) from (id, l5_id, severity, snippet)."""
    words = F.regexp_extract_all(F.lower(F.coalesce("snippet", F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    d = exemplars.select("id", "l5_id", "severity", words.alias("w")).select("id", "l5_id", "severity", F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
    return d.groupBy("term", "id").agg(F.first("l5_id").alias("l5_id"), F.first("severity").alias("severity"), F.count("*").alias("tf"), F.first("length").alias("length")).select(*POSTING.names)


class Index:
    """The index of one version of a store."""

    def __init__(self, store: Store, version: int | None = None):
        self.store, self.version = store, store.version() if version is None else version
        self.name = f"search/v={self.version}"

    def exists(self) -> bool:
        p, fs = self.store._fs(f"{self.name}/totals/_SUCCESS")
        return fs.exists(p)

    def build(self) -> Index:
        """Writes the index if it is not there; the totals, written last, make it count."""
        if not self.exists():
            found = reads._parsed(self.store.read(self.version).nodes.where("type = 'exemplar'"), reads._EXEMPLAR, "id")
            self.store.put(postings(found), f"{self.name}/postings", self.store.buckets, ["term"], overwrite=True)
            words = F.size(F.regexp_extract_all(F.lower(F.coalesce("snippet", F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0)))
            totals = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"), F.lit(self.store.buckets).alias("buckets"))
            totals.write.mode("overwrite").parquet(f"{self.store.path}/{self.name}/totals")
        return self

    def search(self, text: str, l5_id: str | None = None, k: int = 5) -> DataFrame:
        """(id, l5_id, severity, score) of the k exemplars that match best; ties by severity and id. Nothing for a text without words."""
        terms = sorted(set(re.findall("[a-z0-9']+", text.lower())))
        about = self.store.spark.read.parquet(f"{self.store.path}/{self.name}/totals").first()
        found = self.store.get(f"{self.name}/postings", POSTING, about["buckets"], ["term"]).where(F.col("term").isin(terms) if terms else F.lit(False))
        df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the text
        idf = F.log(1 + (about["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wide = 1 - B + B * F.col("length") / max(about["words"] / max(about["n"], 1), 1e-9)
        d = found if l5_id is None else found.where(F.col("l5_id") == l5_id)
        d = d.join(F.broadcast(df), "term").withColumn("s", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * wide))
        d = d.groupBy("id").agg(F.first("l5_id").alias("l5_id"), F.first("severity").alias("severity"), F.sum("s").alias("score"))
        return d.orderBy(F.desc(F.round("score", 9)), F.desc("severity"), "id").limit(k)
