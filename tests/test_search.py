"""The inverted index against plain Python."""

import json
import math
import re

from pyspark.sql import functions as F

from gripeline.plans import graph, search

TEXTS = ["Parcel late, parcel lost.", "Card declined at checkout", "late late LATE", "", "The parcel's late again and again", "refund of the card"]


def test_search(spark, tmp_path):
    rows = [(f"exemplar:{i}", "exemplar", json.dumps({"conversation_id": str(i), "l5_id": f"l{i % 2}", "snippet": t, "severity": float(i % 3)}), None, None, "1") for i, t in enumerate(TEXTS * 2)]
    nodes = spark.createDataFrame([*rows, ("other", "x", "{}", None, None, "1")], graph.NODE)
    none = graph.empty(spark)
    store = graph.Store(spark, f"file://{tmp_path}/g", buckets=4)
    store.write(graph.Graph(nodes, none.edges, none.runs), base=0)
    index = search.Index(store)
    assert not index.exists() and index.build().exists() and index.build().exists()
    words = [re.findall("[a-z0-9']+", t.lower()) for t in TEXTS * 2]
    average = sum(map(len, words)) / len(words)

    def plain(q, leaf=None, k=5):
        out = []
        for i, w in enumerate(words):
            s = 0.0
            for t in set(re.findall("[a-z0-9']+", q.lower())):
                df = sum(t in x for x in words)
                if t in w:
                    s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / average))
            if s and leaf in (None, f"l{i % 2}"):
                out.append((-round(s, 9), -float(i % 3), f"exemplar:{i}"))
        return [x[2] for x in sorted(out)[:k]]

    for q, leaf in (("late parcel", None), ("card", "l1"), ("nothing like it", None), ("", None), ("!?", None), ("the LATE card", None)):
        assert [r["id"] for r in index.search(q, leaf).collect()] == plain(q, leaf), q
    found = store.get(f"{index.name}/postings", search.POSTING, 4, ["term"]).where("term in ('late')")
    assert "EqualTo(term,late)" in found._jdf.queryExecution().executedPlan().toString()
    files = {r["f"] for r in found.select(F.input_file_name().alias("f")).collect()}
    for f in (tmp_path / "g" / index.name / "postings").glob("part-*"):
        if not any(f.name in x for x in files):
            f.unlink()
    assert len(files) == 1 and found.count() == 6  # the files of other buckets are not even opened
    store.commit(graph.Graph(none.nodes, none.edges, none.runs), 1)
    assert not search.Index(store).exists() and index.exists()  # an index is of one version
