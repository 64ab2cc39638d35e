import logging
from datetime import datetime

import pytest

from gripeline import contract as c

ROW = ("c1", datetime(2024, 1, 1), "t", "leaf", "neg", 0, 1, 0, 0, 0)
SCHEMA = "conversation_id string, created_at timestamp, text string, l5_id string, sentiment string, churn_intent int, financial_harm int, safety_legal int, repeat_contact int, unresolved int"


def table_a(spark, **change):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    row = tuple(change.get(n, v) for n, v in zip(names, ROW, strict=True))
    return spark.createDataFrame([row], SCHEMA)


def test_good_table(spark):
    assert c.validate_table_a(table_a(spark)).count() == 1


def test_missing_columns(spark):
    with pytest.raises(c.ContractError, match="missing required columns.*churn_intent"):
        c.validate_table_a(spark.createDataFrame([("a",)], "conversation_id string"))


@pytest.mark.parametrize("change", [{"sentiment": "angry"}, {"sentiment": None}, {"churn_intent": 2}, {"unresolved": None}, {"l5_id": " "}, {"l5_id": None}, {"created_at": None}])
def test_bad_values(spark, change):
    with pytest.raises(c.ContractError, match=next(iter(change))):
        c.validate_table_a(table_a(spark, **change))


def test_severity_range(spark):
    a = table_a(spark)
    assert c.validate_table_a(a.selectExpr("*", "cast(null as double) severity")).count() == 1
    with pytest.raises(c.ContractError, match="severity"):
        c.validate_table_a(a.selectExpr("*", "6.0D severity"))


def test_table_b(spark):
    b = spark.createDataFrame([("c1", "UPS", 3.0)], "conversation_id string, carrier string, order_total double")
    assert c.validate_table_b(b) == ["carrier"]
    assert c.validate_table_b(b, ["carrier"]) == ["carrier"]
    with pytest.raises(c.ContractError, match="declared"):
        c.validate_table_b(b, ["vendor"])
    with pytest.raises(c.ContractError, match="no categorical dimension columns detected"):
        c.validate_table_b(b.drop("carrier"))
    with pytest.raises(c.ContractError, match="missing required columns"):
        c.validate_table_b(b.drop("conversation_id"))


def ids(spark, *x):
    return spark.createDataFrame([(i, "v") for i in x], "conversation_id string, d string")


def test_join(spark, caplog):
    assert c.validate_join(ids(spark, "a", "b", "c"), ids(spark, "a", "b")) == pytest.approx(2 / 3)
    with pytest.raises(c.ContractError):
        c.validate_join(ids(spark, "a", "b"), ids(spark, "x", "y"))
    with caplog.at_level(logging.WARNING):
        assert c.validate_join(ids(spark, "a", "b", "c", "d"), ids(spark, "a", "a")) == 0.25
    assert "25.0" in caplog.text


def test_too_many_values(spark):
    b = spark.range(3000).selectExpr("cast(id as string) conversation_id", "cast(id as string) ticket", "cast(id % 5 as string) carrier")
    c.validate_values(b, ["ticket", "carrier"])
    with pytest.raises(c.ContractError, match="ticket"):
        c.validate_values(b, ["ticket", "carrier"], 1000)


def test_ids_are_never_broadcast(spark, tmp_path):
    """Files of dictionary-coded columns look small, whatever the number of their rows."""
    from gripeline.operators import drivers as dr

    for name, n in (("a", 100), ("b", 60)):
        spark.range(n).selectExpr("cast(id as string) conversation_id", "'leaf' l5_id", "cast(id % 3 as string) carrier").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    for d in (c.join_coverage(a, b), dr.merge(a, b.drop("l5_id"), ["carrier"])):
        assert d.count()
        assert "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert tuple(c.join_coverage(a, b).first()) == (100, 60, 0.6)


def test_coverage_counts_ids_once_and_joins_no_null(spark):
    assert tuple(c.join_coverage(ids(spark, "a", "a", None, "b"), ids(spark, "a", "a", None, "z")).first()) == pytest.approx((3, 1, 1 / 3))
