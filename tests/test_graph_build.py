from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gripeline import __main__ as command
from gripeline.plans import build, graph, reads, report, tools
from gripeline.schemas import TABLE_A
from gripeline.sources import planted, taxonomy
from gripeline.streaming import incremental

NODE = "id string, type string, props string, embedding array<float>, pack_version string, updated_at string"


def node(spark, *rows):
    return spark.createDataFrame([(i, t, p, e, v, "1") for i, t, p, e, v in rows], NODE)


def edge(spark, *rows):
    return spark.createDataFrame([(f"{s}:{t}:{d}", s, t, d, p, "1") for s, t, d, p in rows], "id string, src string, type string, dst string, props string, updated_at string")


def test_upserts(spark):
    old = node(spark, ("a", "x", '{"v":1}', [1.0, 0.0], "p1"))
    new = node(spark, ("a", "y", '{"v":2}', None, None), ("b", "x", "{}", None, None))
    r = {x["id"]: x for x in graph.upsert_nodes(old, new).collect()}
    assert (r["a"]["type"], r["a"]["props"], r["a"]["embedding"], r["a"]["pack_version"]) == ("x", '{"v":2}', [1.0, 0.0], "p1") and "b" in r
    e = graph.upsert_edges(edge(spark, ("a", "affects", "b", '{"lift":2.0}')), edge(spark, ("a", "affects", "b", '{"lift":3.0}')))
    assert [x["props"] for x in e.collect()] == ['{"lift":3.0}']


def test_query_traverse_vectors(spark):
    n = node(spark, ("a", "p", '{"vol":1}', [1.0, 0.0, 0.0], None), ("b", "p", '{"vol":3}', [0.9, 0.1, 0.0], None), ("c", "p", "{}", [0.0, 0.0, 0.0], None))
    assert [r["id"] for r in graph.query(n, "p", order_by="vol").collect()] == ["b", "a", "c"]
    assert [r["id"] for r in graph.query(n, "p", {"vol": None}).collect()] == ["c"] and graph.query(n, "p", order_by="vol", limit=1).count() == 1
    e = edge(spark, ("a", "t", "b", "{}"), ("b", "t", "c", "{}"))
    seen, found = graph.traverse(e, "a", depth=2)
    assert {r["id"] for r in seen.collect()} == {"a", "b"} and found.count() == 2
    assert {r["id"] for r in graph.traverse(e, "a", depth=1)[0].collect()} == {"a"}
    assert graph.get_edges(e, "b", "both").count() == 2 and graph.get_edges(e, "b", "in", "t").count() == 1
    assert [r["id"] for r in graph.vector_search(n, [1.0, 0.0, 0.0], 5).collect()] == ["a", "b"]
    assert graph.co_occurs(spark.createDataFrame([("a", "b")], "a string, b string"), "1").count() == 2


LEAVES = ["late_delivery", "payment_failure", "unauthorized_charge", "app_crash", "long_wait"]


def table_a(spark, pack, weeks=10, each=40):
    full = {x: next(i for i in pack.ids() if i.endswith(x)) for x in LEAVES}
    rows = []
    for w in range(weeks):
        for leaf in LEAVES:
            for i in range(each + (each // 2 if leaf == "late_delivery" and w >= weeks - 3 else 0)):
                rows.append((f"{leaf}-{w}-{i}", datetime(2024, 1, 1) + timedelta(weeks=w), f"{leaf.replace('_', ' ')} trouble number {i}. Please fix it soon. Thanks", full[leaf], "very_neg" if i % 3 == 0 else "neg", int(i % 5 == 0), int("charge" in leaf and i % 2 == 0), 0, int(i % 7 == 0), int(i % 4 == 0)))
    return spark.createDataFrame(rows, TABLE_A)


def test_build_reads_report(spark, tmp_path):
    pack = taxonomy.own_pack()
    a = table_a(spark, pack).persist()
    b = planted.plant(a, ["carrier", "payment_method", "device_type"])
    store = graph.Store(spark, f"file://{tmp_path}/graph")
    r = build.run(a, b, store, "run1", "t1", pack)
    assert r.summary["n_l5"] == 5 and r.summary["n_transcripts"] == 2060 and r.version == 1
    g = store.read()
    c = {x["l5_id"]: x for x in reads.curated_set(g).collect()}
    late = next(x for x in c if x.endswith("late_delivery"))
    assert len(c) == 5 and c[late]["zscore"] == pytest.approx(1.6202, abs=2e-3) and {x["movement"] for x in c.values()} == {"new"}
    assert reads.drivers_of(g, late).count() > 0 and reads.exemplars_of(g, late).count() == 3
    d = reads.drivers_of(g, late, significant_only=True).first()
    assert d["value"] == "USPS" and reads.verify_claim(g, late, d["dimension"], d["value"])["verdict"] == "verified"
    assert reads.verify_claim(g, late, "x", "y")["reason"] == "no edge"
    assert reads.ops_hotspots(g).count() == 15 and reads.search(g, "delivery trouble").count() == 5
    assert reads.leaf_profile(g, "none").first()["found"] is False and reads.leaf_profile(g, late).first()["found"]
    assert reads.systemic_drivers(g).count() >= 1 and reads.top_leaves(g, n=2).count() == 2 and reads.period_series(g, late).count() == 1
    g2 = reads.write_insight(g, late, "run1", "s", "c", "a", ["dim:carrier:USPS"], "t1")
    assert reads.insights_of(g2, late).count() == 1
    # a second run of the same period: nothing moves, the history keeps one entry
    again = build.run(a, b, store, "run2", "t2", pack)
    g = store.read()
    assert again.version == 2 and {x["movement"] for x in reads.curated_set(g).collect()} == {"stable"}
    assert {len(x["history"]) for x in reads.affects(g).collect()} == {1} and {x["volume_delta"] for x in reads.curated_set(g).collect()} == {0}
    assert [x["run_id"] for x in reads.list_runs(g).collect()] == ["run2", "run1"] and store.read(1).runs.count() == 1
    said = tools.drivers(g, late)
    assert said["drivers"][0]["value"] == "USPS" and 0 < len(said["drivers"]) <= 10 and said["total_cells"] >= len(said["heatmap_top"]) > 0
    known = tools.memory(g2, late)
    assert known["latest_period"]["week"] == r.summary["period"] and known["prior_insights"][0]["cause"] == "c" and 0 < len(known["driver_trends"]) <= 5
    assert sum(tools.curated(g)["by_tier"].values()) == 5
    md, js = report.render(g, "run2", str(tmp_path))
    text = open(md).read()
    assert "## Hotspots\n\n- carrier=" in text and "late_delivery" in text and "✓" in text and open(js).read().startswith("{")
    assert spark.read.json(f"{store.snapshot('run2')}/nodes").count() == g.nodes.count()


def some_graph(spark, *nodes, edges=(), runs=()):
    return graph.Graph(node(spark, *nodes), edge(spark, *edges), spark.createDataFrame(list(runs), graph.RUN))


def state(g):
    return {r["id"]: (r["type"], r["props"], r["embedding"], r["pack_version"]) for r in g.nodes.collect()}, {(r["src"], r["type"], r["dst"]): r["props"] for r in g.edges.collect()}, {r["run_id"]: r["n"] for r in g.runs.collect()}


def test_store_survives_a_writer_that_stops(spark, tmp_path, monkeypatch):
    store = graph.Store(spark, f"file://{tmp_path}/g", buckets=2, patience=0.3)
    assert store.version() == 0 and store.read().nodes.count() == 0
    assert store.write(some_graph(spark, ("a", "x", "{}", None, None)), base=0) == 1
    two = some_graph(spark, ("b", "x", "{}", None, None))

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_segment", "_append"):  # before the data; after the data, before the entry
        with monkeypatch.context() as m:
            m.setattr(graph.Store, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.commit(two, base=1)
        assert store.version() == 1 and set(state(store.read())[0]) == {"a"}
    (tmp_path / "g/log/2.json").touch()  # a writer that stopped between making its entry and filling it
    assert store.version() == 1 and set(state(store.read())[0]) == {"a"}
    with pytest.raises(RuntimeError, match="repair"):
        store.commit(two, base=1)
    store.repair()
    assert store.commit(two, base=1) == 2 and set(state(store.read())[0]) == {"a", "b"} and set(state(store.read(1))[0]) == {"a"}


def test_writers_of_one_version_lose_nothing(spark, tmp_path):
    store = graph.Store(spark, f"file://{tmp_path}/g", buckets=2)
    store.write(some_graph(spark, ("a", "x", "{}", None, None)), base=0)
    base = store.read().version
    one, two = (some_graph(spark, (i, "x", "{}", None, None), edges=[("a", "t", i, "{}")]) for i in "bc")
    assert store.commit(one, base) == 2
    for late in (lambda: store.commit(two, base), lambda: store.write(two, base), lambda: store.write(two)):
        with pytest.raises(graph.Conflict):
            late()
    with pytest.raises(graph.Conflict):  # both saw version 2 as the newest, and one has made its entry since
        store._append(2, {})

    first = []

    def make(g):
        if not first:  # someone else commits while this update is made
            first.append(g.version)
            store.commit(some_graph(spark, ("d", "x", "{}", None, None)), g.version)
        return two

    assert store.update(make) == 4 and first == [2]
    nodes, edges, _ = state(store.read())
    assert set(nodes) == set("abcd") and set(edges) == {("a", "t", "b"), ("a", "t", "c")}


def test_updates_merge_and_compact(spark, tmp_path):
    """Deltas read like the same upserts one after another, before and after compaction; the base is not shuffled."""
    store = graph.Store(spark, f"file://{tmp_path}/g", buckets=3, compact_after=4)
    many = [(f"n{i}", "x", f'{{"v":{i}}}', [float(i)], "p1") for i in range(300)]
    links = [(f"n{i}", "t", f"n{i + 1}", "{}") for i in range(299)]
    g = some_graph(spark, *many, edges=links, runs=[("r0", "w", 1, None, "t")])
    store.write(g, base=0)
    updates = [
        some_graph(spark, ("n1", "y", '{"v":-1}', None, None), ("new", "y", "{}", None, None), edges=[("n1", "t", "n2", '{"k":1}'), ("new", "t", "n1", "{}")], runs=[("r1", "w", 2, None, "t")]),
        some_graph(spark, ("new", "z", '{"k":2}', [9.0], None), ("n1", "z", "{}", [5.0], "p2"), runs=[("r1", "w", 3, None, "t")]),
        some_graph(spark, ("n1", "z", '{"last":1}', None, None), edges=[("n1", "t", "n2", '{"k":3}')]),
    ]
    for u in updates:
        g = graph.Graph(graph.upsert_nodes(g.nodes, u.nodes), graph.upsert_edges(g.edges, u.edges), g.runs)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "g").rglob("*.parquet"))
    before = size()
    for i, u in enumerate(updates):
        assert store.commit(u, base=i + 1) == i + 2
    assert size() - before < 3 * 6 * 2500  # some small files an update, whatever the graph's size
    want = state(g)
    got = state(store.read())
    assert got[:2] == want[:2] and got[2] == {"r0": 1, "r1": 3}
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    plan = store.read().nodes._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan") if store.entry(4)["base"] in x]
    assert scans and "Bucketed: true" in scans[0] and plan.count("Exchange ") == 1, plan  # that of the deltas
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert state(store.read(1))[2] == {"r0": 1} and store.read().nodes.count() == 301
    assert store.read(1).nodes.unionByName(store.read(2).nodes).groupBy("id").count().count() == 301  # a union of bucketed tables
    assert store.commit(some_graph(spark, ("end", "x", "{}", None, None)), base=4) == 6  # the fourth update, and its compaction
    assert store.entry(6)["deltas"] == [] and set(state(store.read())[0]) == {*want[0], "end"} and state(store.read())[1:] == (want[1], {"r0": 1, "r1": 3})


def test_walks(spark):
    """Plans grow by one join a level at most; several starts; cycles; ends early."""
    n = 40
    e = edge(spark, *[(f"a{i}", "t", f"a{(i + 1) % n}", "{}") for i in range(n)], *[(f"a{i}", "u", f"a{(i * 7) % n}", "{}") for i in range(0, n, 5)], ("b0", "t", "b1", "{}"))
    near = {f"a{i}": [f"a{(i + 1) % n}"] + ([f"a{(i * 7) % n}"] if i % 5 == 0 else []) for i in range(n)} | {"b0": ["b1"]}

    def plain(starts, depth):
        seen = {s: 0 for s in starts}
        for d in range(1, depth):
            for x in [y for i, k in list(seen.items()) if k == d - 1 for y in near.get(i, [])]:
                seen.setdefault(x, d)
        return seen

    joins = []
    for depth in (1, 2, 4, 7):
        seen, found = graph.traverse(e, ["a3", "b0"], depth)
        assert {r["id"]: r["distance"] for r in seen.collect()} == plain(["a3", "b0"], depth)
        assert {(r["src"], r["dst"]) for r in found.collect()} == {(i, j) for i in plain(["a3", "b0"], depth) for j in near.get(i, [])}
        joins.append(seen._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert joins == [0, 0, 0, 0]
    assert {r["id"] for r in graph.traverse(e, "b1", 9, direction="in")[0].collect()} == {"b0", "b1"}
    assert {r["id"] for r in graph.traverse(e, "a0", 3, types=["t"])[0].collect()} == {"a0", "a1", "a2"}


def test_increments(spark, tmp_path):
    pack = taxonomy.own_pack()
    a = table_a(spark, pack, weeks=4, each=20).persist()
    b = planted.plant(a, ["carrier"], facts=False)
    store = graph.Store(spark, f"file://{tmp_path}/g")
    r = incremental.run_slice(a, b, store, 1, "t", size=200, pack=pack)
    assert r.summary["n_transcripts"] == 200 and incremental.run_slice(a, b, store, 1, "t", size=200, pack=pack).summary["skipped"]
    a.write.parquet(f"{tmp_path}/in")
    told = command.main(["--tagged", f"file://{tmp_path}/in", "--graph", f"file://{tmp_path}/demo", "--demo", "150", "--report", f"{tmp_path}/out", "--run-id", "d1"])
    assert told["n_transcripts"] == 150 and told["version"] == 1 and told["report"][0].endswith("report_d1.md")
    q = incremental.run_stream(incremental.read_stream(spark, f"{tmp_path}/in", a.schema), b, store, f"{tmp_path}/ck", pack)
    q.awaitTermination(180)
    assert store.read().runs.where(F.col("run_id").startswith("stream")).count() == 1


def test_an_update_joins_nothing(spark, tmp_path, monkeypatch):
    """What nodes and edges are made of is written before, so the plan of an update has no join that the driver would broadcast for."""
    pack, plans, commit = taxonomy.own_pack(), [], graph.Store.commit
    a = table_a(spark, pack, weeks=4, each=20).persist()

    def seen(store, update, base):
        plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (update.nodes, update.edges))
        return commit(store, update, base)

    monkeypatch.setattr(graph.Store, "commit", seen)
    build.run(a, planted.plant(a, ["carrier"], facts=False), graph.Store(spark, f"file://{tmp_path}/g"), "r", "t", pack)
    assert [p.count("Join") for p in plans] == [0, 0] and all("parquet" in p for p in plans), plans
