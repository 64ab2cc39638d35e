import pytest
from pyspark.sql import functions as F

from gripeline.operators import drivers as dr
from gripeline.sources import files, taxonomy, threads


def test_replies_from_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("text,tweet_id,in_response_to_tweet_id,created_at\n\"hello, @you\",1,,Tue Oct 31 22:10:47 +0000 2017\nagain,2,1,Tue Oct 31 22:11:47 +0000 2017\nlost,3,99,nonsense\n")
    r = files.read_replies(spark, str(path))
    assert r.count() == 3 and dict(r.dtypes)["tweet_id"] == "string"
    d = r.select(F.col("tweet_id").cast("long").alias("id"), F.col("in_response_to_tweet_id").cast("long").alias("parent"), threads.reply_time(F.col("created_at")).alias("created_at"), "text")
    out = {x["conversation_id"]: x for x in threads.assemble(d, threads.thread_roots(d.select("id", "parent"))).collect()}
    assert out[1]["text"] == "hello, | again" and str(out[1]["created_at"]) == "2017-10-31 22:10:47" and out[3]["created_at"] is None
    with pytest.raises(FileNotFoundError):
        files.read_replies(spark, str(tmp_path / "none.csv"))
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_replies(spark, str(path))


def test_parquet_and_packs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_parquet(spark, str(tmp_path / "none"))
    files.write_parquet(spark.range(3), str(tmp_path / "t"))
    assert files.read_parquet(spark, str(tmp_path / "t")).count() == 3
    p = taxonomy.own_pack()
    files.write_taxonomy(p.to_dict(), str(tmp_path / "p.json"))
    assert taxonomy.Pack.from_dict(files.read_taxonomy(str(tmp_path / "p.json"))).nodes == p.nodes
    up = taxonomy.parents(p.frame(spark))
    assert up.where("level = 1").select("parent").distinct().count() == 3 and up.select("child").distinct().count() > len(p.ids())


def test_induced_taxonomy(spark):
    rows = [(str(i), f"battery drains overnight charging {i}", [1.0, 0.0 + i / 1000]) for i in range(30)] + [(str(100 + i), f"refund cancelled order charge {i}", [0.0 - i / 1000, 1.0]) for i in range(30)]
    p = taxonomy.induce(spark.createDataFrame(rows, "conversation_id string, text string, embedding array<double>"), k=2)
    names = sorted(p.ids())
    assert len(names) == 2 and any("battery" in n for n in names) and any("refund" in n for n in names)
    assert all(len(p.path(n)) == 5 for n in names) and {p.path(n)[0] for n in names} == {"pre_sale", "post_sale"}


def test_interactions(spark):
    d = spark.createDataFrame([(str(i), "A" if i % 2 else "B", "x" if i % 2 else None, "y") for i in range(80)], "conversation_id string, l5_id string, p string, q string")
    merged, names = dr.interactions(d, [("p", "q")])
    got = {(r["l5_id"], r["value"]): r["support"] for r in dr.cell_counts(merged, names).collect()}
    assert got == {("A", "x×y"): 40, ("B", "x×y"): 0, ("A", "__missing__×y"): 0, ("B", "__missing__×y"): 40}


def test_induction_by_density(spark):
    words = {0: "refund missing", 1: "login password"}
    rows = [(f"c{i}", f"The {words[i % 2]} trouble", [float(30 * (i % 2)) + (i % 5) / 10, float(i % 7) / 10]) for i in range(40)] + [("odd", "something else entirely", [500.0, -300.0]), ("none", "text", None)]
    pack = taxonomy.induce(spark.createDataFrame(rows, "conversation_id string, text string, embedding array<float>"), method="density")
    assert [n["path"][3] for n in pack.nodes.values()] == ["missing_refund_trouble", "login_password_trouble"] and len(pack.nodes) == 2
