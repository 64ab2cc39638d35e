"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def clean(text: Column) -> Column:
    """Without mentions and URLs, white space collapsed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)@\w+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)https?://\S+", ""), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends, bars and line breaks, trimmed, empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\s*\|\s*|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1))


def overlap(text: Column, query: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for an empty query."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))).cast("double"), F.size(q)), F.lit(0.0))


def with_snippet(d: DataFrame, text: str, query: Column, k: int = 2, chars: int = 500, out: str = "snippet") -> DataFrame:
    """``d`` with the k sentences of ``text`` that fit ``query`` best, in their order; the first k if none fits.

    BM25 over the sentences of one text, for the distinct tokens of its query. Each step is a column of its own, so that
    sentences are split once and document frequencies counted once a token; a generator keeps later filters from undoing that.
    """
    own = [c for c in d.columns if c != out]
    d = d.select(*own, sentences(F.col(text)).alias("_s"), F.array_distinct(tokens(query)).alias("_q"))
    d = d.select(*own, "_s", "_q", F.transform("_s", tokens).alias("_b"))
    n = F.size("_b")
    df = F.transform("_q", lambda t: F.size(F.filter("_b", lambda b: F.array_contains(b, t))))
    mean = F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.size(b)) / F.greatest(n, F.lit(1))
    d = d.select(*own, "_s", "_b", F.arrays_zip(F.col("_q").alias("t"), df.alias("df")).alias("_d"), F.greatest(mean, F.lit(1.0)).alias("_m"), n.alias("_n"))

    def score(bag: Column) -> Column:
        def one(x: Column) -> Column:
            tf = F.size(F.filter(bag, lambda y: y == x["t"])).cast("double")
            idf = F.log(1 + (F.col("_n") - x["df"] + 0.5) / (x["df"] + 0.5))
            return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(bag) / F.col("_m")))

        return F.aggregate(F.filter("_d", lambda x: F.array_contains(bag, x["t"])), F.lit(0.0), lambda s, x: s + one(x))

    d = d.select(*own, "_s", F.size("_d").alias("_k"), F.transform("_b", lambda b, i: F.struct(score(b).alias("score"), (-i).alias("at"))).alias("_r"))
    d = d.select(*own, "_s", "_k", F.slice(F.sort_array("_r", asc=False), 1, k).alias("_r"))
    d = d.select(*own, "_s", "_k", F.exists("_r", lambda x: x["score"] > 0).alias("_f"), F.array_sort(F.transform("_r", lambda x: -x["at"])).alias("_r"))
    first = F.array_join(F.slice("_s", 1, k), " ")
    chosen = F.array_join(F.transform("_r", lambda i: F.get("_s", i)), " ")
    snippet = F.when(F.size("_s") <= k, F.trim(F.coalesce(F.col(text), F.lit("")))).when((F.col("_k") == 0) | ~F.col("_f"), first).otherwise(chosen)
    return d.select(*own, F.inline(F.array(F.struct(F.substring(snippet, 1, chars).alias(out)))))
