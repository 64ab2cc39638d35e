"""Table A and Table B from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(x: Column, at: tuple[float, float, float]) -> Column:
    return F.when(x < at[0], "pos").when(x < at[1], "neutral").when(x < at[2], "neg").otherwise("very_neg")


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def orders_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("conversation_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("").alias("text"),
        F.col("o_orderpriority").alias("l5_id"), _cut(F.col("o_totalprice"), (125000.0, 250000.0, 375000.0)).alias("sentiment"),
        _flag(F.col("o_orderkey") % 5 == 0).alias("churn_intent"), _flag(F.col("o_orderstatus") == "F").alias("financial_harm"),
        _flag(F.col("o_orderkey") % 13 == 0).alias("safety_legal"), _flag(F.col("o_custkey") % 7 == 0).alias("repeat_contact"), _flag(F.col("o_orderstatus") == "P").alias("unresolved"),
    )


ORDER_DIMENSIONS = ["c_mktsegment", "nation", "region", "order_status"]


def orders_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(
        F.col("o_orderkey").cast("string").alias("conversation_id"), "c_mktsegment", F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("order_total"),
    )


def events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("conversation_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("props").alias("text"), F.col("event_type").alias("l5_id"),
        _cut(F.col("value"), (25.0, 75.0, 150.0)).alias("sentiment"), _flag(F.col("user_id") % 5 == 0).alias("churn_intent"), _flag(F.col("event_id") % 7 == 0).alias("financial_harm"),
        _flag(F.col("event_id") % 13 == 0).alias("safety_legal"), _flag(F.col("user_id") % 3 == 0).alias("repeat_contact"), _flag(F.col("event_id") % 4 == 0).alias("unresolved"),
    )


def documents_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conversation_id, l5_id, text, severity, sentiment): documents by source, severity from their labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    severity = F.lit(2.0) + 2.0 * F.coalesce(F.col("toxic"), F.lit(0)) + 1.0 * (1 - F.coalesce(F.col("quality"), F.lit(1)))
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").cast("string").alias("conversation_id"), F.col("source").alias("l5_id"), "text", severity.alias("severity"), F.lit("neg").alias("sentiment"))


def lines_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    d = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return d.select(key.alias("conversation_id"), F.concat_ws("-", "l_returnflag", "l_linestatus", "p_type").alias("l5_id"))


LINE_DIMENSIONS = ["p_brand", "s_nation", "region", "c_mktsegment", "o_orderpriority"]


def lines_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {x: table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region")}
    d = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return d.select(key.alias("conversation_id"), "p_brand", F.col("n_name").alias("s_nation"), F.col("r_name").alias("region"), "c_mktsegment", "o_orderpriority")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, created_at, text): conversations as replies, each turn answering the one before."""
    c = table(spark, sf_dir, "conversations")
    rid = F.col("conv_id") * 100000 + F.col("turn")
    return c.select(rid.alias("id"), F.when(F.col("turn") > 0, rid - 1).alias("parent"), F.timestamp_seconds(F.lit(1_500_000_000) + rid).alias("created_at"), "text")
