import pytest
from pyspark.sql import functions as F

from gripeline.functions import text
from gripeline.operators import themes as th
from gripeline.sources import tagger, taxonomy, threads


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def snippet(spark, t, q, k, chars=500):
    return text.with_snippet(spark.createDataFrame([(t,)], "t string"), "t", F.lit(q), k, chars).first()["snippet"]


def test_bm25(spark):
    t = "My app crashed. | The refund was delayed and has not arrived. | Thanks for reading."
    assert "refund" in snippet(spark, t, "refund delayed not arrived", 1)
    assert snippet(spark, " One sentence only. ", "x", 2) == "One sentence only."
    assert snippet(spark, t, "", 1) == "My app crashed."
    assert snippet(spark, t, "zebra", 1) == "My app crashed." and snippet(spark, None, "x", 1) == ""


def test_split_overlap_clean(spark):
    assert value(spark, text.sentences(F.lit("a. b | c"))) == ["a.", "b", "c"]
    assert value(spark, text.overlap(F.lit("refund is late"), F.lit("late refund"))) == 1.0
    assert value(spark, text.overlap(F.lit("refund"), F.lit("zebra"))) == 0.0 and value(spark, text.overlap(F.lit("a"), F.lit(""))) == 0.0
    assert value(spark, text.clean(F.lit("@josé  see https://x.y/z now please"))) == "see now please"


def corpus(spark):
    rows = []
    for i in range(40):
        rows.append((f"b{i}", "battery", "The battery drains quickly overnight." if i % 2 else "Battery drains while charging overnight.", 4.0))
        rows.append((f"r{i}", "refund", "Refund never arrived after cancellation." if i % 2 else "My refund request was cancelled twice.", 3.0))
    rows += [(f"o{i}", "other", f"Something else entirely happened here number {i}", 1.0) for i in range(30)] + [("s", "single", "lonely words", 1.0)]
    return spark.createDataFrame(rows, "conversation_id string, l5_id string, text string, severity double")


def test_subthemes(spark):
    s = th.subthemes(corpus(spark), min_docs_per_theme=3, min_docs=10)
    by = {}
    for r in s.orderBy("l5_id", "place").collect():
        by.setdefault(r["l5_id"], []).append(r)
    assert any("battery" in r["label"] or "drains" in r["label"] for r in by["battery"])
    assert all(r["count"] >= 3 and 0 < r["share"] <= 1 and r["quote"] for x in by.values() for r in x)
    assert by["battery"][0]["severity"] == 4.0 and "single" not in by
    assert th.subthemes(corpus(spark).limit(0)).count() == 0


def test_overlap_dedupe(spark):
    t = spark.createDataFrame([("a", 1, "battery drains", 5, 0.9), ("a", 2, "battery", 5, 0.8), ("a", 3, "overnight", 5, 0.7)], "l5_id string, place int, term string, n_cls long, distinct double")
    assert [r["term"] for r in th.drop_overlapping(t).orderBy("place").collect()] == ["battery drains", "overnight"]


def test_exemplars(spark):
    d = th.exemplars(corpus(spark).withColumn("sentiment", F.lit("neg")))
    assert d.groupBy("l5_id").count().where("count > 3").count() == 0
    assert [r["conversation_id"] for r in d.where("l5_id = 'battery'").orderBy("place").collect()] == ["b0", "b1", "b10"]


@pytest.mark.parametrize("ids", [range(1, 40)])
def test_thread_roots(spark, ids):
    rows = [(i, i - 1 if i > 1 else None) for i in ids] + [(100, 999), (101, 100), (201, 202), (202, 203), (203, 201), (204, 201), (300, 300), (7001, 7000), (7000, None)]
    got = {r["id"]: r["root"] for r in threads.thread_roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert {got[i] for i in ids} == {1} and got[101] == got[100] == 100 and got[300] == 300 and got[7001] == 7000
    assert got[201] == got[202] == got[203] == got[204] == 201


def test_tagging(spark):
    p = taxonomy.own_pack()
    c = spark.createDataFrame([("1", "My parcel arrives after the promised date, worst service, cancel it"), ("2", None)], "conversation_id string, text string")
    tagged, new = tagger.tag_conversations(c, p)
    r = {x["conversation_id"]: x for x in tagged.collect()}
    assert r["1"]["l5_id"].endswith("late_delivery") and r["1"]["sentiment"] == "very_neg" and r["1"]["churn_intent"] == 1
    assert new.count() == 2

    class Silent:
        def tag(self, conversations, pack):
            return tagger.RuleTagger().tag(conversations, pack).limit(0)

    again, fresh = tagger.tag_conversations(c, p, Silent(), new.where(F.col("raw_l5").endswith("late_delivery")))
    r = {x["conversation_id"]: x for x in again.collect()}
    assert fresh.count() == 0 and r["1"]["confidence"] > 0 and (r["2"]["confidence"], r["2"]["unresolved"], r["2"]["l5_id"]) == (0.0, 1, p.ids()[0])


def test_batches(spark):
    d = spark.range(100).selectExpr("cast(id as string) conversation_id")
    parts = [{r[0] for r in threads.batch_slice(d, k, 30).collect()} for k in (1, 2, 3, 4)]
    assert [len(x) for x in parts] == [30, 30, 30, 10] and len(set().union(*parts)) == 100
    assert threads.exact_sample(d, 7).count() == 7 and {r[0] for r in threads.exact_sample(d, 7).collect()} == {r[0] for r in threads.exact_sample(d.repartition(5), 7).collect()}


def test_tfidf_asks_by_batch(spark, monkeypatch):
    """Many batches, rows of one contact, contacts without words or id: the same as counting term by term; no term is shuffled by contact."""
    import math
    from collections import Counter, defaultdict

    rows = [(None if i == 7 else f"c{i % 37}", f"leaf{i % 3}", None if i == 5 else "" if i == 6 else " ".join(f"wx{chr(97 + i * j % 11)}y" for j in range(i % 9))) for i in range(60)]
    a = spark.createDataFrame(rows, "conversation_id string, l5_id string, text string")
    monkeypatch.setattr(th, "BATCH", 64)
    found = th.tfidf(a, min_df=2, max_df=0.5, stops=[])
    assert "Window" in found._jdf.queryExecution().executedPlan().toString() and "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    df, tf = Counter(), defaultdict(Counter)
    for c, leaf, t in rows:
        w = (t or "").split()
        terms = w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]
        df.update(set(terms))
        tf[c, leaf].update(terms)
    raw = {(c, leaf, t): (n, (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1)) for (c, leaf), x in tf.items() for t, n in x.items() if 2 <= df[t] <= 0.5 * len(rows)}
    norm = defaultdict(float)
    for (c, _, _), (_, r) in raw.items():
        norm[c] += r * r
    want = {k: (n, pytest.approx(r / math.sqrt(norm[k[0]]))) for k, (n, r) in raw.items()}
    assert {(r[0], r[1], r[2]): (r[3], r[4]) for r in found.collect()} == want and len(want) > 50
    assert not th.tfidf(a.limit(0)).count()


def test_no_text_is_shuffled_for_quotes(spark, tmp_path):
    rows = [(f"c{i}", "battery" if i % 2 else "refund", "The battery drains fast. Odd." if i % 2 else "My refund is late. Odd.", 3.0) for i in range(40)]
    spark.createDataFrame(rows, "conversation_id string, l5_id string, text string, severity double").write.parquet(f"{tmp_path}/a")
    found = th.subthemes(spark.read.parquet(f"{tmp_path}/a"), min_docs=10, max_df=0.6)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert [x for x in plan.splitlines() if "LeftSemi" in x and "BroadcastHashJoin" in x]
    assert {r["quote"] for r in found.collect()} == {"The battery drains fast.", "My refund is late."}
