"""Weekly volumes, trailing z-scores, full-window statistics and the ranking of leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..folders import Tables
from ..functions.scores import iso_week, sentiment_number
from .ordered import percentiles


def _value(a: DataFrame, column: str | None) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)) if column and column in a.columns else F.lit(0.0)


def weekly_metrics(a: DataFrame, order_value: str | None = None) -> DataFrame:
    """By leaf and ISO week: volume, severity_avg, sentiment_avg, order_value_sum. ``a`` has severity."""
    d = a.withColumn("week", iso_week(F.col("created_at")))
    return d.groupBy("l5_id", "week").agg(
        F.count("conversation_id").alias("volume"), F.avg("severity").alias("severity_avg"),
        F.avg(sentiment_number(F.col("sentiment"))).alias("sentiment_avg"), _value(a, order_value).alias("order_value_sum"),
    )


def zscores(weekly: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """By leaf: latest_week, latest_volume, zscore, baseline_mean, baseline_std.

    The baseline is the weeks observed before the latest one, ``baseline_weeks`` at most; too few weeks give z = 0.
    """
    place = F.row_number().over(Window.partitionBy("l5_id").orderBy(F.desc("week")))
    d = weekly.select("l5_id", "week", F.col("volume").cast("double").alias("v"), place.alias("rn"))
    base = F.when(F.col("rn").between(2, cfg.baseline_weeks + 1), F.col("v"))
    g = d.groupBy("l5_id").agg(
        F.max("week").alias("latest_week"), F.max(F.when(F.col("rn") == 1, F.col("v"))).cast("long").alias("latest_volume"),
        F.count("*").alias("_n"), F.count(base).alias("_b"), F.avg("v").alias("_all"), F.avg(base).alias("_mean"), F.stddev_samp(base).alias("_std"),
    )
    short = (F.col("_n") < cfg.min_periods) | (F.col("_b") < cfg.min_periods)
    std = F.greatest(F.coalesce("_std", F.lit(0.0)), F.lit(cfg.std_floor))
    return g.select(
        "l5_id", "latest_week", "latest_volume",
        F.when(short, 0.0).otherwise((F.col("latest_volume") - F.col("_mean")) / std).alias("zscore"),
        F.when(F.col("_n") < cfg.min_periods, F.col("_all")).otherwise(F.col("_mean")).alias("baseline_mean"),
        F.when(short, 0.0).otherwise(std).alias("baseline_std"),
    )


def window_stats(a: DataFrame, order_value: str | None = None) -> DataFrame:
    """By leaf over the whole window: total_volume, severity_avg, sentiment_avg, order_value_sum."""
    column = order_value if order_value in a.columns else "order_total"
    return a.groupBy("l5_id").agg(
        F.count("conversation_id").alias("total_volume"), F.avg("severity").alias("severity_avg"),
        (F.avg(sentiment_number(F.col("sentiment"))) if "sentiment" in a.columns else F.avg("severity")).alias("sentiment_avg"),
        _value(a, column).alias("order_value_sum"),
    )


def egregiousness(stats: DataFrame, z: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """By leaf: the weighted blend of four percentiles, and these. A leaf without a z-score has z = 0.

    Negative z counts as zero; without any order value its weight goes to the three others in their default shares
    .40/.30/.30. Ranks come from a range sort; the leaves' figures are written once for it.
    """
    d = stats.join(z.select("l5_id", "zscore"), "l5_id", "left").select(
        "l5_id", "total_volume", "severity_avg", F.greatest(F.coalesce("zscore", F.lit(0.0)), F.lit(0.0)).alias("spike"), "order_value_sum"
    )
    tables = Tables(stats.sparkSession, "ranking")
    d = tables.cut(d)
    valued = (d.agg(F.sum("order_value_sum")).first()[0] or 0) > 0
    third = cfg.weight_value / 3
    named = {"total_volume": "pct_volume", "severity_avg": "pct_severity", "spike": "pct_spike", "order_value_sum": "pct_value"}
    ranks = percentiles(d, "l5_id", list(named), tables)
    d = ranks.select("l5_id", *(F.col(f"pct_{c}").alias(name) for c, name in named.items() if c != "order_value_sum"), (F.col("pct_order_value_sum") if valued else F.lit(0.0)).alias("pct_value"))
    with_value = cfg.weight_volume * F.col("pct_volume") + cfg.weight_severity * F.col("pct_severity") + cfg.weight_spike * F.col("pct_spike") + cfg.weight_value * F.col("pct_value")
    without = (cfg.weight_volume + third) * F.col("pct_volume") + (cfg.weight_severity + third) * F.col("pct_severity") + (cfg.weight_spike + third) * F.col("pct_spike")
    return d.select("l5_id", (with_value if valued else without).alias("egregiousness"), "pct_volume", "pct_severity", "pct_spike", "pct_value")
