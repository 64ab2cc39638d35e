"""The driver cube: which dimension values go with which leaf, by how much, and whether by chance.

The merged table is unpivoted to (leaf, dimension, value) and counted once; partial aggregation leaves some leaves × values rows
for each task before the shuffle, and all marginals come from that count. What follows works on cells, not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..folders import Tables
from ..functions.stats import two_proportion_p
from .ordered import benjamini_hochberg

MISSING = "__missing__"
CELL = ("l5_id", "dimension", "value")


def merge(a: DataFrame, b: DataFrame, dimensions: list[str]) -> DataFrame:
    """A ⋈ B on the conversation, with the leaf and the dimensions only; both grow with the input, so neither is broadcast."""
    keep = [c for c in dimensions if c in b.columns]
    return a.select("conversation_id", "l5_id").join(b.select("conversation_id", *keep).hint("merge"), "conversation_id")


def cell_counts(merged: DataFrame, dimensions: list[str]) -> DataFrame:
    """(l5_id, dimension, value, support, n_d, n_l5, n_total): all leaves by all values, zero support included.

    The counts are written: the marginals filter and sum them, and each would join and count all rows again for that.
    """
    present = [c for c in dimensions if c in merged.columns]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in present))).alias("x")
    counted = merged.select("l5_id", pairs).groupBy("l5_id", "x.dimension", "x.value").agg(F.count("*").alias("support"))
    counted = Tables(merged.sparkSession, "cube").cut(counted)
    values = counted.groupBy("dimension", "value").agg(F.sum("support").alias("n_d"))
    one = counted.where(F.col("dimension") == present[0]).groupBy("l5_id").agg(F.sum("support").alias("n_l5"))
    leaves = one.crossJoin(F.broadcast(one.agg(F.sum("n_l5").alias("n_total"))))  # one row
    # leaves × values is what the cube consists of: two small tables whatever the number of rows
    return values.crossJoin(leaves).join(counted, list(CELL), "left").select(*CELL, F.coalesce("support", F.lit(0)).cast("long").alias("support"), "n_d", "n_l5", "n_total")


def effects(cells: DataFrame) -> DataFrame:
    expected = F.col("n_l5").cast("double") * F.col("n_d") / F.col("n_total")
    return cells.select(
        "*", (F.col("support") / F.col("n_l5")).alias("share"), (F.col("support") / expected).alias("lift"), (F.col("support") - expected).alias("excess"),
    )


def test_cells(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cells with p_raw (null below min_support), p_value (adjusted over all tested cells; 1 below) and significant."""
    tested = F.col("support") >= cfg.min_support
    p = two_proportion_p(F.col("support"), F.col("n_d"), F.col("n_l5") - F.col("support"), F.col("n_total") - F.col("n_d"))
    d = Tables(cells.sparkSession, "cells").cut(cells.withColumn("p_raw", F.when(tested, p)))  # read by the ranking and by both parts of the result
    adjusted = benjamini_hochberg(d.where(tested), "p_raw", "p_value", *CELL)
    rest = d.where(~tested).withColumn("p_value", F.lit(1.0))
    return adjusted.unionByName(rest).withColumn("significant", F.col("p_raw").isNotNull() & (F.col("p_value") < cfg.alpha))


def keep_top(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Of each leaf and dimension the cells of most support (ties by value), and all significant ones."""
    place = F.row_number().over(Window.partitionBy("l5_id", "dimension").orderBy(F.desc("support"), "value"))
    return cells.withColumn("_place", place).where((F.col("_place") <= cfg.top_k) | F.col("significant")).drop("_place")


def append_history(edges: DataFrame, before: DataFrame | None, period: str | Column) -> DataFrame:
    """Edges with period and history: the entries of ``before`` (cell, history) and one of now, unless the last is of this period."""
    now = F.lit(period) if isinstance(period, str) else period
    entry = F.struct(now.alias("period"), F.col("support"), F.round("share", 4).alias("share"), F.round("lift", 4).alias("lift"))
    kind = "array<struct<period:string,support:bigint,share:double,lift:double>>"
    d = edges.withColumn("history", F.array().cast(kind)) if before is None else edges.join(before.select(*CELL, "history"), list(CELL), "left")
    h = F.coalesce(F.col("history"), F.array().cast(kind))
    last = F.try_element_at(h, F.lit(-1))["period"]
    return d.withColumn("period", now).withColumn("history", F.when(last == now, h).otherwise(F.concat(h, F.array(entry).cast(kind))))


def drivers(merged: DataFrame, dimensions: list[str], period: str | Column, before: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    kept = keep_top(test_cells(effects(cell_counts(merged, dimensions)), cfg), cfg)
    return append_history(kept, before, period).select(*CELL, "support", "share", "lift", "p_value", "significant", "excess", "period", "history")


def top_drivers(edges: DataFrame, k: int = 5) -> DataFrame:
    """The significant edges of most lift of each leaf, ranked."""
    place = F.row_number().over(Window.partitionBy("l5_id").orderBy(F.desc("lift"), "dimension", "value"))
    return edges.where("significant").withColumn("place", place).where(F.col("place") <= k)


def facets(edges: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """The values of most share of each leaf and dimension, with a share of ``least`` or more."""
    place = F.row_number().over(Window.partitionBy("l5_id", "dimension").orderBy(F.desc("share"), "value"))
    return edges.withColumn("place", place).where((F.col("place") <= k) & (F.col("share") >= least)).select("l5_id", "dimension", "value", "place", "share", "lift", "significant")


def systemic(edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """By dimension value: in how many leaves it is a significant driver."""
    d = edges.where("significant").groupBy("dimension", "value").agg(
        F.sort_array(F.collect_set("l5_id")).alias("affected_l5s"), F.countDistinct("l5_id").cast("int").alias("n_significant"),
        F.sum("support").alias("total_support"), F.avg("lift").alias("mean_lift"), F.max("lift").alias("max_lift"),
    )
    raw = F.col("n_significant") * F.col("mean_lift")
    names, most = d.columns, F.col("_most")
    d = d.crossJoin(F.broadcast(d.agg(F.max(raw).alias("_most"))))  # one row
    return d.select(
        *names, (F.col("n_significant") >= cfg.bridge_leaves).alias("is_bridge"), (F.col("n_significant") == 1).alias("is_singleton"),
        (raw / F.when(most == 0, 1.0).otherwise(most)).alias("systemic_score"),
    )


def hotspots(edges: DataFrame, k: int = 3, dimension: str | None = None) -> DataFrame:
    """The leaves of most support of each dimension value."""
    d = edges if dimension is None else edges.where(F.col("dimension") == dimension)
    place = F.row_number().over(Window.partitionBy("dimension", "value").orderBy(F.desc("support"), "l5_id"))
    return d.withColumn("place", place).where(F.col("place") <= k).select("dimension", "value", "place", "l5_id", "support", "lift", "significant")


def verify(edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Edges with verified: significant, lift above one, enough support."""
    return edges.withColumn("verified", F.col("significant") & (F.col("lift") > 1) & (F.col("support") >= cfg.min_support))


def claim(dimension: Column, value: Column, l5: Column, lift: Column, n: Column) -> Column:
    return F.concat(dimension, F.lit("="), value, F.lit(" over-indexes for "), l5, F.lit(" (lift "), lift.cast("string"), F.lit("x, n="), n.cast("string"), F.lit(")"))


def interactions(merged: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """An extension: two-way dimensions ``a×b`` beside the others, for cubes of pairs."""
    names = [f"{x}×{y}" for x, y in pairs]
    cols = [F.concat_ws("×", F.coalesce(F.col(x), F.lit(MISSING)), F.coalesce(F.col(y), F.lit(MISSING))).alias(n) for (x, y), n in zip(pairs, names, strict=True)]
    return merged.select("*", *cols), names
