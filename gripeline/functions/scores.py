"""Row-wise scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, SENTIMENTS, Config

#: Spellings of sentiment that are mapped before the check against the four values (fixed values).
SENTIMENT_ALIASES = {
    "negative": "neg",
    "positive": "pos",
    "very negative": "very_neg",
    "very_negative": "very_neg",
    "very positive": "pos",
    "very_positive": "pos",
}
SENTIMENT_NUMBER = {"very_neg": 1.0, "neg": 2.0, "neutral": 3.0, "pos": 4.0}


def choose(col: Column, values: dict, default) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(default)


def severity(columns: list[str], cfg: Config = DEFAULT) -> Column:
    """Rubric: sentiment base, weighted signals, one for a repeated or unresolved contact, clamped."""
    has = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in columns else F.lit(0.0)
    base = choose(F.col("sentiment"), cfg.sentiment_severity, 1.0) if "sentiment" in columns else F.lit(1.0)
    for s, w in cfg.signal_weight.items():
        base = base + w * has(s)
    base = base + ((has("repeat_contact") > 0) | (has("unresolved") > 0)).cast("double")
    return F.least(F.lit(cfg.severity_max), F.greatest(F.lit(cfg.severity_min), base))


def with_severity(a: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``a`` with severity: its own column if every row has one, else the rubric for every row."""
    rubric = severity(a.columns, cfg)
    if "severity" not in a.columns:
        return a.withColumn("severity", rubric)
    full = a.agg((F.count("severity") == F.count("*")).alias("_full"))
    return a.crossJoin(F.broadcast(full)).withColumn("severity", F.when(F.col("_full"), F.col("severity").cast("double")).otherwise(rubric)).drop("_full")


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def sentiment_number(col: Column) -> Column:
    return choose(col, SENTIMENT_NUMBER, 2.5)


def normalise_sentiment(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    key = choose(key, SENTIMENT_ALIASES, key)
    return F.when(key.isin(*SENTIMENTS), key).otherwise("neg")


def tier(score: Column, cfg: Config = DEFAULT) -> Column:
    out = F
    for name, least in cfg.tiers:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def trend(z: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(z >= cfg.spike, "rising").when(z <= cfg.falling, "falling").otherwise("stable")


def movement(before: Column, now: Column, cfg: Config = DEFAULT) -> Column:
    """How a tier moved since the run before."""
    ranks = {name: len(cfg.tiers) - i for i, (name, _) in enumerate(cfg.tiers)}
    b, n = choose(before, ranks, 0), choose(now, ranks, 0)
    return F.when(before.isNull(), "new").when(n > b, "escalated").when(n < b, "de-escalated").otherwise("stable")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one of them has length zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(dot, norm(a) * norm(b))
