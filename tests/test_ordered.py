"""Ranks, running sums and adjusted p-values over parts, with ties that lie across their borders."""

import random

import pytest
from pyspark.sql import functions as F

from gripeline.folders import Tables
from gripeline.operators import ordered


@pytest.fixture(autouse=True)
def parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([0.0, 0.01, 0.01, 0.04, rng.random(), 1.0])) for i in range(n)]


def no_single_task(d):
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "Exchange SinglePartition" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_benjamini_hochberg(spark, n):
    p = rows(n)
    got = ordered.benjamini_hochberg(spark.createDataFrame(p, "i int, p double").repartition(5), "p", "adjusted", "i")
    ranked, least, want = sorted(p, key=lambda x: (x[1], x[0])), 1.0, {}
    for k in range(n, 0, -1):
        i, x = ranked[k - 1]
        least = min(least, x * n / k)
        want[i] = least
    assert {r["i"]: pytest.approx(r["adjusted"], abs=1e-12) for r in got.collect()} == want
    no_single_task(got)


def test_percentiles(spark):
    d = [(i, x, None if i % 10 == 0 else float(i % 3), 5.0) for i, x in rows(200, 2)]
    got = ordered.percentiles(spark.createDataFrame(d, "i int, a double, b double, c double").repartition(5), "i", ["a", "b", "c"], Tables(spark, "t"))
    found = {r["i"]: r for r in got.collect()}
    for c, name in ((1, "a"), (2, "b"), (3, "c")):
        values = [-1.0 if r[c] is None else r[c] for r in d]
        for r, v in zip(d, values):
            average = sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
            assert found[r[0]][f"pct_{name}"] == pytest.approx((average - 1) / 199)
    no_single_task(got)
    assert ordered.percentiles(spark.createDataFrame([], "i int, a double"), "i", ["a"], Tables(spark, "t")).count() == 0


def test_places_and_sums(spark):
    d = spark.createDataFrame([(i, x, i % 4) for i, x in rows(150, 3)], "i int, x double, n int").repartition(6)
    tables = Tables(spark, "t")
    order = (F.col("x").desc(), F.col("i").asc())
    want = sorted(d.collect(), key=lambda r: (-r["x"], r["i"]))
    assert [r["i"] for r in sorted(ordered.places(d, tables, *order).collect(), key=lambda r: r["at"])] == [r["i"] for r in want]
    got = {r["i"]: r["before"] for r in ordered.sums_before(d, tables, "n", "before", *order).collect()}
    total = 0
    for r in want:
        assert got[r["i"]] == total
        total += r["n"]


def test_tables_are_cleaned(spark, tmp_path):
    tables = Tables(spark, "gone")
    d = tables.cut(spark.range(3))
    assert d.count() == 3 and tables.root in Tables.roots
    other = Tables(spark, "other").cut(spark.range(2))
    tables.drop(d)
    assert other.count() == 2
    Tables.clean(spark)
    assert Tables.roots == []
    with pytest.raises(Exception, match="exist|FAILED_READ"):
        spark.read.schema(other.schema).parquet(other._cut_path).count()
