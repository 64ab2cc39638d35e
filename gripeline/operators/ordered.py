"""Ranks and running sums over all rows without one task for all rows: range sorts, and one number a sorted part on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import Tables


def parted(d: DataFrame, tables: Tables, *order: Column) -> DataFrame:
    """``d`` range-sorted and written, with _part (parts are in order) and _at (ascending in that order, with gaps between parts)."""
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return tables.cut(d.withColumn("_part", F.shiftright("_at", 33).cast("int")))


def _carried(d: DataFrame, rows: list[tuple[int, float]], kind: str) -> DataFrame:
    """``d`` with _before, the number that comes into its part."""
    return d.join(d.sparkSession.createDataFrame(rows, f"_part int, _before {kind}"), "_part")


def _placed(d: DataFrame) -> tuple[DataFrame, int]:
    """``d`` as ``parted`` gives it, with ``at``: 0, 1, 2, ...; and how many rows there are."""
    before, rows = 0, []
    for r in sorted(d.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r["count"]
    in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return _carried(d, rows, "long").withColumn("at", F.col("_before") + in_part).drop("_before"), before


def places(d: DataFrame, tables: Tables, *order: Column) -> DataFrame:
    """``d`` with ``at``: 0, 1, 2, ... in that order; equal rows in any order."""
    return _placed(parted(d, tables, *order))[0].drop("_at", "_part")


def sums_before(d: DataFrame, tables: Tables, value: str, out: str, *order: Column) -> DataFrame:
    """``d`` with ``out``: the sum of ``value`` (whole numbers) over all rows before a row in that order, which should be total."""
    d = parted(d, tables, *order)
    before, rows = 0, []
    for r in sorted(d.groupBy("_part").agg(F.sum(value).alias("s")).collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], before))
        before += r["s"]
    in_part = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _carried(d.withColumn("_own", in_part), rows, "long").withColumn(out, F.col("_before") + F.col("_own")).drop("_at", "_part", "_before", "_own")


def least_from_here(d: DataFrame, value: Column, out: str) -> DataFrame:
    """For ``d`` as ``parted`` gives it, with ``out``: the least ``value`` of a row and all that come after it."""
    d = d.withColumn("_value", value)
    least, rows = float("inf"), []
    for r in sorted(d.groupBy("_part").agg(F.min("_value").alias("m")).collect(), key=lambda r: -r["_part"]):
        rows.append((r["_part"], least))
        least = min(least, r["m"])
    own = F.min("_value").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(0, Window.unboundedFollowing))
    return _carried(d.withColumn("_own", own), rows, "double").withColumn(out, F.least("_own", "_before")).drop("_value", "_own", "_before")


def percentiles(d: DataFrame, key: str, columns: list[str], tables: Tables) -> DataFrame:
    """(key, pct_<column>...): (average rank - 1) / (n - 1) of each column's values over all rows; 0.5 for a single row. Keys are unique, nulls rank first."""
    d = tables.cut(d.select(F.col(key).alias("_key"), F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))).alias("x")))
    n = d.count()
    long = d.select("_key", F.explode("x").alias("x")).select("_key", "x.i", "x.v")
    counts = sums_before(long.groupBy("i", "v").agg(F.count("*").alias("n")), tables, "n", "below", F.col("i"), F.col("v").asc_nulls_first())
    # below counts the columns before this one too, n rows each; of n equal values the average rank is in the middle
    middle = F.col("below") - F.col("i") * F.lit(n) + (F.col("n") - 1) / 2.0
    share = F.lit(0.5) if n <= 1 else middle / F.lit(n - 1.0)
    counts = counts.select(F.col("i").alias("_i"), F.col("v").alias("_v"), share.alias("share"))
    ranked = long.join(counts, (F.col("i") == F.col("_i")) & F.col("v").eqNullSafe(F.col("_v")))
    return ranked.groupBy(F.col("_key").alias(key)).agg(*(F.max(F.when(F.col("i") == i, F.col("share"))).alias(f"pct_{c}") for i, c in enumerate(columns)))


def benjamini_hochberg(tests: DataFrame, p: str, out: str, *ties: str) -> DataFrame:
    """``tests`` with adjusted p-values, all rows one family: p·m/rank, made monotone from the largest p down.

    The family is as large as the cube, so it is ranked by a range sort; what the parts after a row bring is a number a part.
    """
    d, m = _placed(parted(tests, Tables(tests.sparkSession, "family"), F.col(p).asc(), *(F.col(c).asc() for c in ties)))
    d = least_from_here(d, F.col(p) * F.lit(float(m)) / (F.col("at") + 1), "_least")
    return d.withColumn(out, F.least(F.lit(1.0), F.col("_least"))).drop("_least", "at", "_at", "_part")
