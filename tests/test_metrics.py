from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gripeline.folders import Tables
from gripeline.functions import scores, stats
from gripeline.operators import metrics as me
from gripeline.operators import ordered

SIG = "sentiment string, churn_intent int, financial_harm int, safety_legal int, repeat_contact int, unresolved int"


@pytest.mark.parametrize(
    ("row", "want"),
    [(("very_neg", 0, 0, 0, 0, 0), 3), (("neg", 0, 0, 0, 0, 0), 2), (("neutral", 0, 0, 0, 0, 0), 1), (("pos", 0, 0, 0, 0, 0), 1), (("neutral", 1, 0, 0, 0, 0), 2), (("very_neg", 1, 1, 1, 1, 1), 5), (("neutral", 0, 0, 0, 1, 1), 2), (("?", None, None, None, None, None), 1)],
)
def test_rubric(spark, row, want):
    assert scores.with_severity(spark.createDataFrame([row], SIG)).first()["severity"] == want


def test_severity_column_counts_only_if_full(spark):
    rows = [("neg", 0, 0, 0, 0, 0, 4.5), ("neg", 0, 0, 0, 0, 0, 3.5)]
    assert {r["severity"] for r in scores.with_severity(spark.createDataFrame(rows, SIG + ", severity double")).collect()} == {4.5, 3.5}
    rows[1] = (*rows[1][:-1], None)
    assert {r["severity"] for r in scores.with_severity(spark.createDataFrame(rows, SIG + ", severity double")).collect()} == {2.0}


def weekly(spark, volumes, leaf="A"):
    rows = [(leaf, f"2024-W{i + 1:02d}", v, 2.0, 2.0, 0.0) for i, v in enumerate(volumes)]
    return spark.createDataFrame(rows, "l5_id string, week string, volume long, severity_avg double, sentiment_avg double, order_value_sum double")


def test_spike(spark):
    r = me.zscores(weekly(spark, [10] * 9 + [100])).first()
    assert (r["zscore"], r["baseline_mean"], r["baseline_std"], r["latest_week"], r["latest_volume"]) == (180.0, 10.0, 0.5, "2024-W10", 100)


def test_known_z(spark):
    assert me.zscores(weekly(spark, [100] * 7 + [150] * 3)).first()["zscore"] == pytest.approx(1.6202, abs=1e-4)


@pytest.mark.parametrize(("volumes", "mean"), [([10], 10), ([10, 20], 15), ([10, 20, 60], 15)])
def test_short_history(spark, volumes, mean):
    r = me.zscores(weekly(spark, volumes)).first()
    assert (r["zscore"], r["baseline_mean"], r["baseline_std"]) == (0.0, mean, 0.0)


def test_weeks(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09", "2024-01-15"]
    rows = [(str(i), datetime.fromisoformat(d), "A" if i in (0, 1, 4) else "B", "neg", 2.0) for i, d in enumerate(days)]
    w = me.weekly_metrics(spark.createDataFrame(rows, "conversation_id string, created_at timestamp, l5_id string, sentiment string, severity double"))
    assert {r["week"] for r in w.collect()} == {"2024-W01", "2024-W02", "2024-W03"}
    assert w.where("l5_id = 'A'").agg(F.sum("volume")).first()[0] == 3


def rank(spark, values):
    stats_ = spark.createDataFrame([("A", 100, 3.0, values[0]), ("B", 200, 2.0, values[1]), ("C", 50, 4.0, values[2])], "l5_id string, total_volume long, severity_avg double, order_value_sum double")
    z = spark.createDataFrame([("A", 2.0), ("B", 0.5), ("C", 3.0)], "l5_id string, zscore double")
    return {r["l5_id"]: r for r in me.egregiousness(stats_, z).collect()}


def test_egregiousness(spark):
    assert {k: round(r["egregiousness"], 6) for k, r in rank(spark, (1000.0, 500.0, 2000.0)).items()} == {"A": 0.5, "B": 0.35, "C": 0.65}


def test_no_value_redistributes(spark):
    r = rank(spark, (0.0, 0.0, 0.0))
    assert (round(r["A"]["egregiousness"], 6), round(r["B"]["egregiousness"], 6), r["A"]["pct_value"]) == (0.5, 0.4, 0.0)


def test_percentile_ties(spark):
    tables = Tables(spark, "t")
    d = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3)], "k int, x int")
    assert {r["k"]: round(r["pct_x"], 6) for r in ordered.percentiles(d, "k", ["x"], tables).collect()} == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0}
    assert ordered.percentiles(spark.createDataFrame([(1, 7)], "k int, x int"), "k", ["x"], tables).first()["pct_x"] == 0.5


def test_erfc(spark):
    import math

    xs = [i / 10 for i in range(0, 100)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e")).collect():
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=2e-7)


def test_labels(spark):
    one = spark.range(1)
    t = lambda x: one.select(scores.tier(F.lit(x)).alias("t")).first()["t"]
    assert [t(x) for x in (0.85, 0.6, 0.35, 0.1)] == ["very_high", "high", "fair", "low"]
    m = lambda a, b: one.select(scores.movement(F.lit(a).cast("string"), F.lit(b)).alias("m")).first()["m"]
    assert [m(None, "low"), m("low", "high"), m("high", "fair"), m("low", "low")] == ["new", "escalated", "de-escalated", "stable"]
    z = lambda x: one.select(scores.trend(F.lit(x)).alias("z")).first()["z"]
    assert [z(2.0), z(-1.0), z(0.0)] == ["rising", "falling", "stable"]
