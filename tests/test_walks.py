from pyspark.sql import functions as F

from gripeline.plans import graph as gr


def test_edges_of_a_walk_are_made_once(spark):
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    e = spark.createDataFrame(rows, "src string, dst string").distinct().withColumn("type", F.lit("t"))
    nodes, found = gr.traverse(e, "a", depth=3)
    assert sorted(tuple(r) for r in nodes.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
