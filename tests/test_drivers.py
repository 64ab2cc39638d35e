import pytest

from gripeline.operators import drivers as dr
from gripeline.sources import planted, taxonomy

EDGE = "l5_id string, dimension string, value string, support long, share double, lift double, p_value double, significant boolean, excess double"


def merged(spark, counts):
    rows = [(f"{leaf}{v}{i}", leaf, v) for leaf, v, n in counts for i in range(n)]
    return spark.createDataFrame(rows, "conversation_id string, l5_id string, dim string")


def cells(spark, counts):
    d = dr.drivers(merged(spark, counts), ["dim"], "2024-W01")
    return {(r["l5_id"], r["value"]): r for r in d.collect()}


def test_lift(spark):
    r = cells(spark, [("A", "X", 300), ("A", "Y", 100), ("B", "Y", 500), ("B", "X", 100)])[("A", "X")]
    assert (r["support"], r["share"], r["excess"]) == (300, 0.75, pytest.approx(140))
    assert r["lift"] == pytest.approx(1.875)


def test_significant(spark):
    r = cells(spark, [("A", "X", 250), ("A", "Y", 50), ("B", "Y", 650), ("B", "X", 50)])[("A", "X")]
    assert r["significant"] and r["p_value"] < 0.05 and r["lift"] == pytest.approx(2.7778, abs=1e-4)


def test_single_leaf_missing_and_zero_support(spark):
    r = cells(spark, [("A", "X", 40), ("A", None, 40)])
    assert r[("A", "__missing__")]["p_value"] == 1.0 and not r[("A", "X")]["significant"]
    r = cells(spark, [("A", "X", 40), ("B", "Y", 40)])
    assert r[("A", "Y")]["support"] == 0 and len(r) == 4


def test_sums_and_partitions(spark):
    counts = [(leaf, v, 10 + 7 * i + 3 * j) for i, leaf in enumerate("ABC") for j, v in enumerate("XYZ")]
    d = dr.effects(dr.cell_counts(merged(spark, counts), ["dim"]))
    assert d.agg({"support": "sum"}).first()[0] == sum(n for *_, n in counts)
    for r in d.groupBy("l5_id", "dimension").agg({"share": "sum"}).collect():
        assert r[2] == pytest.approx(1)
    one = dr.effects(dr.cell_counts(merged(spark, counts).coalesce(1), ["dim"]))
    assert sorted(map(str, one.collect())) == sorted(map(str, d.collect()))


def test_history(spark):
    e = spark.createDataFrame([("A", "d", "X", 100, 0.5, 2.0, 0.01, True, 1.0)], EDGE)
    old = spark.createDataFrame([("A", "d", "X", [("W00", 90, 0.45, 2.8)])], "l5_id string, dimension string, value string, history array<struct<period:string,support:bigint,share:double,lift:double>>")
    h = dr.append_history(e, old, "W01").first()["history"]
    assert [x["period"] for x in h] == ["W00", "W01"] and h[1]["support"] == 100
    assert len(dr.append_history(e, old, "W00").first()["history"]) == 1
    assert len(dr.append_history(e, None, "W01").first()["history"]) == 1


def edges(spark):
    rows = [(leaf, "carrier", "DroneX", 50, 0.4, 2.5, 0.001, True, 1.0) for leaf in "abc"]
    rows += [("a", "carrier", "UPS", 40, 0.3, 1.4, 0.01, True, 1.0), ("a", "carrier", "DHL", 30, 0.02, 1.0, 0.9, False, 0.0), ("b", "carrier", "DHL", 30, 0.2, 1.0, 0.9, False, 0.0)]
    return spark.createDataFrame(rows, EDGE)


def test_systemic(spark):
    s = {r["value"]: r for r in dr.systemic(edges(spark)).collect()}
    assert set(s) == {"DroneX", "UPS"}
    assert s["DroneX"]["is_bridge"] and s["DroneX"]["systemic_score"] == 1.0 and s["DroneX"]["affected_l5s"] == ["a", "b", "c"]
    assert s["UPS"]["is_singleton"] and not s["UPS"]["is_bridge"]
    assert dr.systemic(edges(spark).where("not significant")).count() == 0


def test_top_facets_verify(spark):
    e = edges(spark)
    assert [r["value"] for r in dr.top_drivers(e).where("l5_id = 'a'").orderBy("place").collect()] == ["DroneX", "UPS"]
    assert {r["value"] for r in dr.facets(e).where("l5_id = 'a'").collect()} == {"DroneX", "UPS"}
    assert {(r["l5_id"], r["value"]) for r in dr.verify(e).where("verified").collect()} == {("a", "DroneX"), ("b", "DroneX"), ("c", "DroneX"), ("a", "UPS")}
    assert [r["l5_id"] for r in dr.hotspots(e, 2).where("value = 'DroneX'").orderBy("place").collect()] == ["a", "b"]


def test_recovery(spark):
    leaves = ["late_delivery", "payment_failure", "long_wait", "damaged_item", "stock_question"]
    a = spark.range(10_000).selectExpr("cast(id as string) conversation_id", f"element_at(array({', '.join(map(repr, leaves))}), cast(id % 5 + 1 as int)) l5_id", "cast(id % 3 = 0 as int) financial_harm")
    b = planted.plant(a)
    dims = list(planted.DIMENSIONS)
    found = {(r["l5_id"], r["dimension"], r["value"]): r for r in dr.drivers(dr.merge(a, b, dims), dims, "W").collect()}
    for leaf in leaves:
        for d, v, _ in planted.PLANTED.get(leaf, []):
            r = found[(leaf, d, v)]
            assert r["lift"] > 1 and r["significant"], (leaf, d, v)
    f = b.selectExpr("min(quantity)", "max(quantity)", "avg(delivery_minutes)").first()
    assert f[0] == 1 and f[1] == 20 and abs(f[2] - 2880) < 60


def test_pack_and_snapping(spark):
    p = taxonomy.own_pack()
    assert taxonomy.Pack.from_dict(p.to_dict()).nodes == p.nodes and p.ids_below("sale") and p.path("nope") == []
    raw = spark.createDataFrame([(p.ids()[0],), ("x__late_delivery",), ("charge",), ("zzz",), ("",), (None,)], "raw string")
    got = {r["raw"]: r["l5_id"] for r in taxonomy.snap_leaf(raw, p.frame(spark)).collect()}
    assert got[p.ids()[0]] == p.ids()[0] and got["x__late_delivery"].endswith("late_delivery")
    assert got["charge"] == min((i for i in p.ids() if "charge" in i), key=len) and got["zzz"] is None and got[""] is None


def test_rows_are_counted_once(spark):
    """The marginals come from the counts; they do not read the merged rows again."""
    rows, seen = merged(spark, [("A", "X", 30), ("A", "Y", 10), ("B", "Y", 50)]), spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = {(r["l5_id"], r["value"]): (r["support"], r["n_d"], r["n_l5"], r["n_total"]) for r in dr.cell_counts(rows.mapInArrow(through, rows.schema), ["dim"]).collect()}
    assert found == {("A", "X"): (30, 30, 40, 90), ("A", "Y"): (10, 60, 40, 90), ("B", "X"): (0, 30, 50, 90), ("B", "Y"): (50, 60, 50, 90)}
    assert seen.value == 90
