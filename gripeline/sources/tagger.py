"""Tagging of conversations: an interface, a deterministic rule tagger, and a cache of tags."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SIGNALS
from ..functions.scores import normalise_sentiment
from .taxonomy import Pack, snap_leaf

#: Cues of the rule tagger, in patterns over lower-case text.
SIGNAL_CUES = {
    "churn_intent": r"cancel|leaving|switch(ing)? to|never again|close my account",
    "financial_harm": r"charged|overcharg|refund|money|billed|fee",
    "safety_legal": r"lawyer|legal|sue|unsafe|injur|police|danger",
    "repeat_contact": r"again|third time|second time|still (no|not|waiting)|already (called|contacted|wrote)",
    "unresolved": r"no (answer|reply|response)|not (fixed|solved|resolved)|still (no|not|waiting)",
}
VERY_NEGATIVE, NEGATIVE, POSITIVE = r"worst|furious|disgust|terrible|horrible|hate", r"bad|late|broken|wrong|problem|disappoint|missing|not ", r"thank|great|love|awesome|perfect"


class Tagger(Protocol):
    """Turns (conversation_id, text) into rows with raw_l5, sentiment, the signals and confidence."""

    def tag(self, conversations: DataFrame, pack: Pack) -> DataFrame: ...


class RuleTagger:
    """Leaf: the one whose definition shares most words with the text (ties: pack order); sentiment and signals by cues."""

    def tag(self, conversations: DataFrame, pack: Pack) -> DataFrame:
        low = F.lower(F.coalesce("text", F.lit("")))
        words = lambda s: sorted({w for w in s.lower().replace(",", " ").split() if len(w) > 3})
        scores = [
            F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words(n["definition"] + " " + n["path"][-1].replace("_", " "))), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(leaf).alias("leaf"))
            for i, (leaf, n) in enumerate(pack.nodes.items())
        ]
        best = F.array_max(F.array(*scores))
        sentiment = F.when(low.rlike(VERY_NEGATIVE), "very_neg").when(low.rlike(NEGATIVE), "neg").when(low.rlike(POSITIVE), "pos").otherwise("neutral")
        return conversations.select(
            "conversation_id", "text", best["leaf"].alias("raw_l5"), sentiment.alias("sentiment"),
            *(low.rlike(p).cast("int").alias(s) for s, p in SIGNAL_CUES.items()), F.when(best["n"] > 0, 0.5).otherwise(0.1).alias("confidence"),
        )


def cache_key(pack_version: str, prompt_version: str = "1") -> Column:
    return F.sha2(F.concat_ws("|", "conversation_id", F.substring("text", 1, 1000), F.lit(pack_version), F.lit(prompt_version)), 256)


def tag_conversations(conversations: DataFrame, pack: Pack, tagger: Tagger | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tagged conversations, and the cache entries that are new.

    ``cache`` is (key, raw_l5, sentiment, signals, confidence). Misses go to the tagger; a conversation that it leaves out gets
    the fallback tag (first leaf, neg, unresolved, confidence 0), which is not cached. Leaves are snapped onto the pack,
    unmatched ones onto its first.
    """
    spark = conversations.sparkSession
    tags = ("raw_l5", "sentiment", *SIGNALS, "confidence")
    d = conversations.withColumn("key", cache_key(pack.version))
    miss = d if cache is None else d.join(cache.select("key"), "key", "left_anti")
    fresh = (tagger or RuleTagger()).tag(miss.drop("key"), pack).select("conversation_id", *tags)
    new = miss.select("conversation_id", "key").join(fresh, "conversation_id").select("key", *tags)
    known = new if cache is None else cache.select("key", *tags).unionByName(new)
    d = d.join(known.dropDuplicates(["key"]), "key", "left")
    d = snap_leaf(d.withColumnRenamed("raw_l5", "raw"), pack.frame(spark))
    hit = F.col("confidence").isNotNull()
    return d.select(
        *conversations.columns, F.when(hit, F.coalesce("l5_id", F.lit(pack.ids()[0]))).otherwise(F.lit(pack.ids()[0])).alias("l5_id"),
        F.when(hit, normalise_sentiment(F.col("sentiment"))).otherwise("neg").alias("sentiment"),
        *(F.when(hit, F.coalesce(F.col(s), F.lit(0))).otherwise(F.lit(int(s == "unresolved"))).cast("int").alias(s) for s in SIGNALS),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    ), new
