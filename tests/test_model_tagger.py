"""Batches, prompts, and replies of all shapes."""

import json

from pyspark.sql import functions as F

from gripeline.sources import model_tagger as mt
from gripeline.sources import tagger, taxonomy

PACK = taxonomy.own_pack()
LEAF = PACK.ids()[7]


def tag(i, **more):
    return {"conversation_id": i, "l5_id": LEAF, "sentiment": "pos", "churn_intent": 1, "financial_harm": 0, "safety_legal": 0, "repeat_contact": 0, "unresolved": 0, "confidence": 0.75} | more


def test_replies(spark):
    good = [tag("a"), tag("b", confidence=None)]
    cases = {
        1: (json.dumps({"tags": good}), ["a", "b"]), 2: (json.dumps(good), ["a", "b"]), 3: (f"```json\n{json.dumps({'tags': good})}\n```", ["a", "b"]), 4: (f"  ```\n{json.dumps(good)}```  ", ["a", "b"]),
        5: (json.dumps(good)[:-5], None), 6: ("no json", None), 7: (None, None), 8: ("{}", []), 9: ('{"tags": 3}', []), 10: ("7", []), 11: ("[]", []), 12: ("", None), 13: ('["x", 4, {"l5_id": "q"}]', [None, None, None]),
    }
    d = spark.createDataFrame([(i, r) for i, (r, _) in cases.items()], "i int, reply string").select("i", mt.read_reply(F.col("reply")).alias("t"))
    got = {r["i"]: r["ids"] for r in d.select("i", F.transform("t", lambda x: F.try_variant_get(x, "$.conversation_id", "string")).alias("ids")).collect()}
    assert got == {i: want for i, (_, want) in cases.items()}


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(mt, "PART_ROWS", 30)
    d = spark.createDataFrame([(f"c{i}", None if i == 4 else f"text {i} " * 60, "x") for i in range(100)], "conversation_id string, text string, batch string")
    rows = mt.batches(d, 7).withColumn("prompt", mt.prompt(PACK)).collect()
    assert sorted(x["conversation_id"] for r in rows for x in r["items"]) == sorted(f"c{i}" for i in range(100)) and len({r["batch"] for r in rows}) == len(rows)
    assert max(len(r["items"]) for r in rows) == 7 and all([x["conversation_id"] for x in r["items"]] == sorted(x["conversation_id"] for x in r["items"]) for r in rows)
    lines = rows[0]["prompt"].split("\n\n")[-1].split("\n")
    assert lines == [f"[{x['conversation_id']}] {x['text'][:200]}" for x in rows[0]["items"]] and LEAF in rows[0]["prompt"]
    assert mt.batches(d.limit(0), 7).count() == 0


class Says:
    """Replies by the first id of a batch."""

    def __init__(self, replies):
        self.replies = replies

    def ask(self, prompts):
        reply = F.lit(None).cast("string")
        for first, r in self.replies.items():
            reply = F.when(F.get("items", 0)["conversation_id"] == first, F.lit(r)).otherwise(reply)
        return prompts.select("batch", reply.alias("reply"))


def test_tags(spark):
    d = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(8)], "conversation_id string, text string")
    model = Says({
        "c0": json.dumps({"tags": [tag("c0"), tag("c0", sentiment=" Positive"), tag("c1", l5_id="other__" + LEAF.split("__")[-1]), tag("c5")]}),  # the last of c0; c5 is of another batch
        "c2": json.dumps([{"conversation_id": "c2"}]), "c4": "broken {", "c6": json.dumps([tag("c6", churn_intent="1", unresolved=True), tag("c7", l5_id="?", sentiment=5)]),
    })
    tagged, new = tagger.tag_conversations(d, PACK, mt.ModelTagger(model, 2))
    got = {r["conversation_id"]: r for r in tagged.collect()}
    first = PACK.ids()[0]
    assert [got[f"c{i}"]["l5_id"] for i in range(8)] == [LEAF, LEAF, first, first, first, first, LEAF, first]
    assert got["c0"]["confidence"] == 0.75 and got["c1"]["churn_intent"] == 1 and got["c6"]["churn_intent"] == 1
    assert [(got[f"c{i}"]["sentiment"], got[f"c{i}"]["unresolved"], got[f"c{i}"]["confidence"]) for i in (2, 3, 4, 5)] == [("neg", 0, 0.0), ("neg", 1, 0.0), ("neg", 1, 0.0), ("neg", 1, 0.0)]
    assert new.count() == 6  # a broken reply is not cached, a left-out row is


def test_arrow_model(spark):
    d = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(6)], "conversation_id string, text string")

    def call(prompts, leaf=LEAF):  # by itself: workers cannot import this module
        import json

        found = [[line[1 : line.index("]")] for line in p.split("\n\n")[-1].split("\n")] for p in prompts]
        return [json.dumps([{"conversation_id": i, "l5_id": leaf, "sentiment": "pos"} for i in ids]) for ids in found]

    def broken(prompts):
        raise OSError("no model")

    assert {r["l5_id"] for r in tagger.tag_conversations(d, PACK, mt.ModelTagger(mt.ArrowModel(call), 4))[0].collect()} == {LEAF}
    tagged, new = tagger.tag_conversations(d, PACK, mt.ModelTagger(mt.ArrowModel(broken), 4))
    assert {(r["l5_id"], r["confidence"]) for r in tagged.collect()} == {(PACK.ids()[0], 0.0)} and new.count() == 0
