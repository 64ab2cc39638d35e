"""One query per operator of the analytics over the driver's tables, and the same in DuckDB SQL.

Doubles are rounded to six places on both sides; every window has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from . import contract
from .folders import Tables

from .functions import scores, stats, text
from .functions.scores import with_severity
from .operators import drivers as dr
from .operators import metrics as me
from .operators import ordered
from .operators import themes as th
from .plans import graph as gr
from .sources import planted, taxonomy, threads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def a_of(spark: SparkSession, d: str) -> DataFrame:
    return with_severity(ad.orders_a(spark, d))


# --- shared SQL -----------------------------------------------------------------------------------------------------------------
_CUT = "CASE WHEN {x} < {0} THEN 'pos' WHEN {x} < {1} THEN 'neutral' WHEN {x} < {2} THEN 'neg' ELSE 'very_neg' END"
_SEV = """least(5, greatest(1, CASE sentiment WHEN 'very_neg' THEN 3.0 WHEN 'neg' THEN 2.0 ELSE 1.0 END::DOUBLE + churn_intent + financial_harm
  + 2 * safety_legal + CASE WHEN repeat_contact > 0 OR unresolved > 0 THEN 1 ELSE 0 END))::DOUBLE"""
_A = f"""a0 AS (SELECT CAST(o_orderkey AS VARCHAR) AS conversation_id, o_orderdate AS created_at, o_orderpriority AS l5_id,
    {_CUT.format(125000, 250000, 375000, x="o_totalprice")} AS sentiment, CAST(o_orderkey % 5 = 0 AS INT) AS churn_intent, CAST(o_orderstatus = 'F' AS INT) AS financial_harm,
    CAST(o_orderkey % 13 = 0 AS INT) AS safety_legal, CAST(o_custkey % 7 = 0 AS INT) AS repeat_contact, CAST(o_orderstatus = 'P' AS INT) AS unresolved FROM orders),
  a AS (SELECT *, {_SEV} AS severity, CASE sentiment WHEN 'very_neg' THEN 1 WHEN 'neg' THEN 2 WHEN 'neutral' THEN 3 WHEN 'pos' THEN 4 ELSE 2.5 END::DOUBLE AS sn,
    strftime(created_at, '%G-W%V') AS week FROM a0)"""
_B = """b AS (SELECT CAST(o_orderkey AS VARCHAR) AS conversation_id, c_mktsegment, n_name AS nation, r_name AS region, o_orderstatus AS order_status, o_totalprice AS order_total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_WEEKLY = "weekly AS (SELECT l5_id, week, count(conversation_id) AS volume, avg(severity) AS severity_avg, avg(sn) AS sentiment_avg, 0.0::DOUBLE AS order_value_sum FROM a GROUP BY l5_id, week)"
_Z = """wk AS (SELECT l5_id, week, volume::DOUBLE AS v, row_number() OVER (PARTITION BY l5_id ORDER BY week DESC) AS rn FROM weekly),
  zg AS (SELECT l5_id, max(week) AS latest_week, CAST(max(CASE WHEN rn = 1 THEN v END) AS BIGINT) AS latest_volume, count(*) AS n, count(CASE WHEN rn BETWEEN 2 AND 9 THEN v END) AS b,
    avg(v) AS al, avg(CASE WHEN rn BETWEEN 2 AND 9 THEN v END) AS m, stddev_samp(CASE WHEN rn BETWEEN 2 AND 9 THEN v END) AS s FROM wk GROUP BY l5_id),
  z AS (SELECT l5_id, latest_week, latest_volume, CASE WHEN n < 3 OR b < 3 THEN 0.0 ELSE (latest_volume - m) / greatest(coalesce(s, 0), 0.5) END::DOUBLE AS zscore,
    CASE WHEN n < 3 THEN al ELSE m END AS baseline_mean, CASE WHEN n < 3 OR b < 3 THEN 0.0 ELSE greatest(coalesce(s, 0), 0.5) END::DOUBLE AS baseline_std FROM zg)"""
_STATS = "stats AS (SELECT l5_id, count(conversation_id) AS total_volume, avg(severity) AS severity_avg, avg(sn) AS sentiment_avg, {value} AS order_value_sum FROM {a} GROUP BY l5_id)"


def _pct(c: str) -> str:
    return f"CASE WHEN count(*) OVER () <= 1 THEN 0.5 ELSE (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END::DOUBLE"


_EGREG = f"""sp AS (SELECT stats.*, greatest(coalesce(z.zscore, 0), 0) AS spike FROM stats LEFT JOIN z USING (l5_id)),
  pc AS (SELECT l5_id, {_pct("total_volume")} AS pct_volume, {_pct("severity_avg")} AS pct_severity, {_pct("spike")} AS pct_spike,
    CASE WHEN sum(order_value_sum) OVER () > 0 THEN {_pct("order_value_sum")} ELSE 0.0 END::DOUBLE AS pct_value, sum(order_value_sum) OVER () > 0 AS has_value FROM sp),
  egreg AS (SELECT l5_id, CASE WHEN has_value THEN 0.35::DOUBLE * pct_volume + 0.25::DOUBLE * pct_severity + 0.25::DOUBLE * pct_spike + 0.15::DOUBLE * pct_value
    ELSE 0.4::DOUBLE * pct_volume + 0.3::DOUBLE * pct_severity + 0.3::DOUBLE * pct_spike END AS egregiousness, pct_volume, pct_severity, pct_spike, pct_value FROM pc)"""


def _poly(t: str) -> str:
    out = f"{stats.ERFC[-1]!r}::DOUBLE"
    for c in reversed(stats.ERFC[:-1]):
        out = f"({c!r}::DOUBLE + {t} * {out})"
    return out


def _cells(a: str, dims: list[str], b: str = "b") -> str:
    each = " UNION ALL ".join(f"SELECT l5_id, '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), '__missing__') AS value FROM m" for d in dims)
    return f"""m AS (SELECT a.l5_id, b.* FROM {a} a JOIN {b} b ON a.conversation_id = b.conversation_id),
  long AS ({each}),
  cnt AS (SELECT l5_id, dimension, value, count(*) AS support FROM long GROUP BY ALL),
  vals AS (SELECT dimension, value, count(*) AS n_d FROM long GROUP BY ALL),
  lv AS (SELECT l5_id, count(*) AS n_l5, (SELECT count(*) FROM m) AS n_total FROM m GROUP BY l5_id),
  cells AS (SELECT lv.l5_id, vals.dimension, vals.value, coalesce(cnt.support, 0) AS support, n_d, n_l5, n_total FROM vals CROSS JOIN lv
    LEFT JOIN cnt ON cnt.l5_id = lv.l5_id AND cnt.dimension = vals.dimension AND cnt.value = vals.value),
  eff AS (SELECT *, support::DOUBLE / n_l5 AS share, support::DOUBLE / (n_l5::DOUBLE * n_d / n_total) AS lift, support - n_l5::DOUBLE * n_d / n_total AS excess FROM cells),
  var AS (SELECT *, n_l5::DOUBLE / n_total AS pooled, n_total - n_d AS n2 FROM eff),
  zt AS (SELECT *, abs(support::DOUBLE / n_d - (n_l5 - support)::DOUBLE / nullif(n2, 0)) / nullif(sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / n_d + 1.0::DOUBLE / nullif(n2, 0))), 0) / sqrt(2.0) AS x FROM var),
  tt AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * x) AS t FROM zt),
  tested AS (SELECT *, CASE WHEN support >= 30 THEN CASE WHEN n_d < 5 OR n2 < 5 THEN 1.0 ELSE coalesce(t * exp(-x * x + {_poly("t")}), 1.0) END END AS p_raw FROM tt),
  rk AS (SELECT *, row_number() OVER (ORDER BY p_raw, l5_id, dimension, value) AS r, count(*) OVER () AS mm FROM tested WHERE p_raw IS NOT NULL),
  adj AS (SELECT *, least(1.0, min(p_raw * mm / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_value FROM rk),
  fdr AS (SELECT l5_id, dimension, value, support, n_d, n_l5, n_total, share, lift, excess, p_raw, p_value, p_value < 0.05 AS significant FROM adj
    UNION ALL SELECT l5_id, dimension, value, support, n_d, n_l5, n_total, share, lift, excess, p_raw, 1.0, false FROM tested WHERE p_raw IS NULL),
  edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l5_id, dimension ORDER BY support DESC, value) AS place FROM fdr) WHERE place <= 10 OR significant)"""


# --- planted dimensions: Table A of orders, with taxonomy leaves instead of priorities ----------------------------------------------
LEAVES = ["late_delivery", "payment_failure", "long_wait", "damaged_item", "stock_question"]
PLANT_DIMS = list(planted.DIMENSIONS)


def planted_a(spark: SparkSession, d: str) -> DataFrame:
    leaf = F.element_at(F.lit(LEAVES), (F.col("conversation_id").cast("long") % len(LEAVES) + 1).cast("int"))
    return a_of(spark, d).withColumn("l5_id", leaf)


def planted_b(spark: SparkSession, d: str) -> DataFrame:
    return planted.plant(planted_a(spark, d), PLANT_DIMS, facts=False)


def planted_edges(spark: SparkSession, d: str) -> DataFrame:
    merged = planted.plant(planted_a(spark, d), PLANT_DIMS, facts=False, keep=("l5_id",))  # made row by row from Table A: no join
    return dr.drivers(merged, PLANT_DIMS, "2000-W01")


def _pick_sql(dim: str, leaves: list[str] = LEAVES) -> str:
    u = f"(CAST('0x' || substr(md5(conversation_id || '|{dim}|42'), 1, 12) AS BIGINT)::DOUBLE / {float(1 << 48)!r})"
    values = planted.DIMENSIONS[dim]
    one = lambda leaf: "CASE " + " ".join(f"WHEN {u} < {e!r}::DOUBLE THEN '{v}'" for e, v in zip(planted.cumulated(leaf, dim)[:-1], values[:-1], strict=True)) + f" ELSE '{values[-1]}' END"
    return "CASE l5_id " + " ".join(f"WHEN '{x}' THEN {one(x)}" for x in leaves) + " END"


_PA = f"{_A}, pa AS (SELECT * REPLACE (list_extract({LEAVES!r}, CAST(CAST(conversation_id AS BIGINT) % {len(LEAVES)} AS INT) + 1) AS l5_id) FROM a)"
_PB = f"pb AS (SELECT conversation_id, {', '.join(f'{_pick_sql(x)} AS {x}' for x in PLANT_DIMS)} FROM pa)"
_PE = f"WITH {_PA}, {_PB}, {_cells('pa', PLANT_DIMS, 'pb')}"
_OE = f"WITH {_A}, {_B}, {_cells('a', ad.ORDER_DIMENSIONS)}"


# --- contract -----------------------------------------------------------------------------------------------------------------------
#: Every how many rows each check of Table A is broken in the query below.
BROKEN = {"created_at": 89, "sentiment": 101, "churn_intent": 53, "financial_harm": 59, "safety_legal": 61, "repeat_contact": 67, "unresolved": 71, "l5_id": 47, "severity": 73}


@query("SELECT " + ", ".join(f"count(*) FILTER (o_orderkey % {n} = 0) AS {c}" for c, n in BROKEN.items()) + " FROM orders")
def contract_violations(spark, d):
    k, wrong = F.col("conversation_id").cast("long"), {"created_at": "nonsense", "sentiment": "angry", "l5_id": " ", "severity": 5.5}
    a = a_of(spark, d).withColumn("created_at", F.col("created_at").cast("string"))
    return contract.count_violations(a.withColumns({c: F.when(k % n == 0, F.lit(wrong.get(c, 2))).otherwise(F.col(c)) for c, n in BROKEN.items()}))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS id FROM orders), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) AS n_a, count(b.id) AS n_joined, round(count(b.id)::DOUBLE / count(*), 6) AS coverage FROM a LEFT JOIN b USING (id)""")
def join_coverage(spark, d):
    a = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"))
    b = ad.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("conversation_id"))
    return contract.join_coverage(a, b).withColumn("coverage", F.round("coverage", 6))


# --- row functions, weeks, ranks -----------------------------------------------------------------------------------------------------
@query(f"WITH {_A} SELECT conversation_id, severity FROM a")
def severity_rubric(spark, d):
    return a_of(spark, d).select("conversation_id", "severity")


@query("SELECT event_id, strftime(ts, '%G-W%V') AS week FROM events")
def iso_week_label(spark, d):
    return ad.table(spark, d, "events").select("event_id", scores.iso_week(F.col("ts").cast("timestamp")).alias("week"))


@query(f"WITH {_A}, {_WEEKLY} SELECT l5_id, week, volume, round(severity_avg, 6) AS severity_avg, round(sentiment_avg, 6) AS sentiment_avg, order_value_sum FROM weekly")
def weekly_metrics(spark, d):
    return me.weekly_metrics(a_of(spark, d)).select("l5_id", "week", "volume", *r6("severity_avg", "sentiment_avg"), "order_value_sum")


@query(f"WITH {_A}, {_WEEKLY}, {_Z} SELECT l5_id, latest_week, latest_volume, round(zscore, 6) AS zscore, round(baseline_mean, 6) AS baseline_mean, round(baseline_std, 6) AS baseline_std FROM z")
def weekly_zscores(spark, d):
    return me.zscores(me.weekly_metrics(a_of(spark, d))).select("l5_id", "latest_week", "latest_volume", *r6("zscore", "baseline_mean", "baseline_std"))


def _valued(spark, d):
    return a_of(spark, d).join(ad.orders_b(spark, d).select("conversation_id", "order_total"), "conversation_id")


_VALUED = f"{_A}, {_B}, av AS (SELECT a.*, b.order_total FROM a JOIN b USING (conversation_id))"


@query(f"WITH {_VALUED}, {_STATS.format(value='sum(order_total)', a='av')} SELECT l5_id, total_volume, round(severity_avg, 6) AS severity_avg, round(sentiment_avg, 6) AS sentiment_avg, round(order_value_sum, 2) AS order_value_sum FROM stats")
def window_stats(spark, d):
    return me.window_stats(_valued(spark, d)).select("l5_id", "total_volume", *r6("severity_avg", "sentiment_avg"), F.round("order_value_sum", 2).alias("order_value_sum"))


@query(f"SELECT n_nationkey, round({_pct('n_regionkey')}, 6) AS pct FROM nation")
def avg_percentile_rank(spark, d):
    ranked = ordered.percentiles(ad.table(spark, d, "nation"), "n_nationkey", ["n_regionkey"], Tables(spark, "ranks"))
    return ranked.select("n_nationkey", F.round("pct_n_regionkey", 6).alias("pct"))


_ECOLS = "l5_id, round(egregiousness, 6) AS egregiousness, round(pct_volume, 6) AS pct_volume, round(pct_severity, 6) AS pct_severity, round(pct_spike, 6) AS pct_spike, round(pct_value, 6) AS pct_value"


@query(f"WITH {_VALUED}, {_WEEKLY}, {_Z}, {_STATS.format(value='sum(order_total)', a='av')}, {_EGREG} SELECT {_ECOLS} FROM egreg")
def egregiousness(spark, d):
    a = _valued(spark, d)
    return me.egregiousness(me.window_stats(a), me.zscores(me.weekly_metrics(a))).select("l5_id", *r6("egregiousness", "pct_volume", "pct_severity", "pct_spike", "pct_value"))


def _scores(spark, d):
    a = a_of(spark, d)
    z = me.zscores(me.weekly_metrics(a))
    return me.egregiousness(me.window_stats(a), z).join(z, "l5_id")


_NOVALUE = f"WITH {_A}, {_WEEKLY}, {_Z}, {_STATS.format(value='0.0::DOUBLE', a='a')}, {_EGREG}"


@query(f"{_NOVALUE} SELECT {_ECOLS} FROM egreg")
def egregiousness_no_value(spark, d):
    return _scores(spark, d).select("l5_id", *r6("egregiousness", "pct_volume", "pct_severity", "pct_spike", "pct_value"))


_TIER = "CASE WHEN {x} >= 0.85 THEN 'very_high' WHEN {x} >= 0.6 THEN 'high' WHEN {x} >= 0.35 THEN 'fair' ELSE 'low' END"


@query(f"{_NOVALUE} SELECT l5_id, {_TIER.format(x='round(egregiousness, 9)')} AS importance, CASE WHEN zscore >= 2 THEN 'rising' WHEN zscore <= -1 THEN 'falling' ELSE 'stable' END AS trend FROM egreg JOIN z USING (l5_id)")
def importance_trend(spark, d):
    return _scores(spark, d).select("l5_id", scores.tier(F.round("egregiousness", 9)).alias("importance"), scores.trend(F.col("zscore")).alias("trend"))


# --- drivers ---------------------------------------------------------------------------------------------------------------------------
def _effects(spark, d):
    return dr.effects(dr.cell_counts(dr.merge(a_of(spark, d), ad.orders_b(spark, d), ad.ORDER_DIMENSIONS), ad.ORDER_DIMENSIONS))


_CELLCOLS = "l5_id, dimension, value, support, round(share, 6) AS share, round(lift, 6) AS lift"


@query(f"{_OE} SELECT {_CELLCOLS}, n_d, n_l5, n_total, round(excess, 6) AS excess FROM eff")
def driver_cube(spark, d):
    return _effects(spark, d).select("l5_id", "dimension", "value", "support", *r6("share", "lift"), "n_d", "n_l5", "n_total", *r6("excess"))


@query(f"{_OE} SELECT l5_id, dimension, value, round(p_raw, 6) AS p_raw FROM tested")
def driver_ztest(spark, d):
    return dr.test_cells(_effects(spark, d)).select("l5_id", "dimension", "value", *r6("p_raw"))


@query(f"{_OE} SELECT l5_id, dimension, value, round(p_value, 6) AS p_value, significant FROM fdr")
def driver_fdr(spark, d):
    return dr.test_cells(_effects(spark, d)).select("l5_id", "dimension", "value", *r6("p_value"), "significant")


@query(f"{_OE} SELECT {_CELLCOLS}, significant FROM edges")
def drivers_topk(spark, d):
    return dr.keep_top(dr.test_cells(_effects(spark, d))).select("l5_id", "dimension", "value", "support", *r6("share", "lift"), "significant")


@query(f"{_PE} SELECT conversation_id, l5_id, {', '.join(PLANT_DIMS)} FROM pb JOIN pa USING (conversation_id)")
def planted_dims(spark, d):
    return planted_a(spark, d).select("conversation_id", "l5_id").join(planted_b(spark, d), "conversation_id")


@query(f"{_PE} SELECT {_CELLCOLS}, round(p_value, 6) AS p_value, significant FROM edges")
def planted_drivers(spark, d):
    return planted_edges(spark, d).select("l5_id", "dimension", "value", "support", *r6("share", "lift", "p_value"), "significant")


@query(f"{_PE} SELECT {_CELLCOLS}, place FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY l5_id ORDER BY lift DESC, dimension, value) AS place FROM edges WHERE significant) WHERE place <= 5")
def top_drivers(spark, d):
    return dr.top_drivers(planted_edges(spark, d)).select("l5_id", "dimension", "value", "support", *r6("share", "lift"), "place")


@query(f"""{_PE} SELECT l5_id, dimension, value, place, round(share, 6) AS share, round(lift, 6) AS lift, significant
FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY l5_id, dimension ORDER BY share DESC, value) AS place FROM edges) WHERE place <= 3 AND share >= 0.05""")
def facet_breakdown(spark, d):
    return dr.facets(planted_edges(spark, d)).select("l5_id", "dimension", "value", "place", *r6("share", "lift"), "significant")


_SYS = """sy AS (SELECT dimension, value, list_sort(list(DISTINCT l5_id)) AS leaves, CAST(count(DISTINCT l5_id) AS INT) AS n_significant, CAST(sum(support) AS BIGINT) AS total_support, avg(lift) AS mean_lift, max(lift) AS max_lift
  FROM edges WHERE significant GROUP BY dimension, value)"""


@query(f"""{_PE}, {_SYS} SELECT dimension, value, array_to_string(leaves, ',') AS affected_l5s, n_significant, total_support, round(mean_lift, 6) AS mean_lift, round(max_lift, 6) AS max_lift,
  n_significant >= 3 AS is_bridge, n_significant = 1 AS is_singleton, round(n_significant * mean_lift / max(n_significant * mean_lift) OVER (), 6) AS systemic_score FROM sy""")
def systemic_drivers(spark, d):
    s = dr.systemic(planted_edges(spark, d))
    return s.select("dimension", "value", F.array_join("affected_l5s", ",").alias("affected_l5s"), "n_significant", "total_support", *r6("mean_lift", "max_lift"), "is_bridge", "is_singleton", *r6("systemic_score"))


@query(f"{_PE} SELECT dimension, value, place, l5_id, support, round(lift, 6) AS lift, significant FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY dimension, value ORDER BY support DESC, l5_id) AS place FROM edges) WHERE place <= 3")
def ops_hotspots(spark, d):
    return dr.hotspots(planted_edges(spark, d)).select("dimension", "value", "place", "l5_id", "support", *r6("lift"), "significant")


@query(f"{_PE} SELECT l5_id, dimension, value, significant AND lift > 1 AND support >= 30 AS verified FROM edges")
def driver_verification(spark, d):
    return dr.verify(planted_edges(spark, d)).select("l5_id", "dimension", "value", "verified")


@query(f"""WITH {_A}, {_WEEKLY}, p AS (SELECT max(week) AS period FROM weekly), c AS (SELECT l5_id, week, volume FROM weekly WHERE week >= '2001')
SELECT l5_id, CAST(count(*) + CASE WHEN max(week) = (SELECT period FROM p) THEN 0 ELSE 1 END AS INT) AS n_history, max(week) = (SELECT period FROM p) AS kept FROM c GROUP BY l5_id""")
def history_append(spark, d):
    weekly = me.weekly_metrics(a_of(spark, d))
    period = weekly.agg(F.max("week").alias("period"))
    old = weekly.where("week >= '2001'").groupBy("l5_id").agg(F.array_sort(F.collect_list(F.struct(F.col("week").alias("period"), F.col("volume").alias("support"), F.lit(0.0).alias("share"), F.lit(1.0).alias("lift")))).alias("history"))
    old = old.withColumn("dimension", F.lit("d")).withColumn("value", F.lit("v"))
    edges = old.select("l5_id", "dimension", "value", F.lit(1).cast("long").alias("support"), F.lit(0.5).alias("share"), F.lit(2.0).alias("lift")).crossJoin(F.broadcast(period))  # one row
    last = F.element_at("history", -1)
    done = dr.append_history(edges.withColumnRenamed("period", "_now"), old, F.col("_now"))
    return done.select("l5_id", F.size("history").alias("n_history"), (last["lift"] == 1.0).alias("kept"))


@query(f"{_NOVALUE}, t AS (SELECT l5_id, {_TIER.format(x='round(egregiousness, 9)')} AS now, CASE WHEN l5_id LIKE '1%' THEN NULL WHEN l5_id LIKE '2%' THEN 'low' WHEN l5_id LIKE '3%' THEN 'very_high' ELSE 'fair' END AS before FROM egreg)"
       " SELECT l5_id, now, before, CASE WHEN before IS NULL THEN 'new' WHEN rn > rb THEN 'escalated' WHEN rn < rb THEN 'de-escalated' ELSE 'stable' END AS movement FROM"
       " (SELECT *, list_position(['low', 'fair', 'high', 'very_high'], now) AS rn, list_position(['low', 'fair', 'high', 'very_high'], before) AS rb FROM t)")  # fmt: skip
def curation_movement(spark, d):
    s = _scores(spark, d).select("l5_id", scores.tier(F.round("egregiousness", 9)).alias("now"))
    first = F.substring("l5_id", 1, 1)
    s = s.withColumn("before", F.when(first == "1", F.lit(None)).when(first == "2", "low").when(first == "3", "very_high").otherwise("fair"))
    return s.withColumn("movement", scores.movement(F.col("before"), F.col("now")))


@query(f"WITH {_A} SELECT l5_id, conversation_id, place, severity FROM (SELECT *, row_number() OVER (PARTITION BY l5_id ORDER BY severity DESC, conversation_id) AS place FROM a) WHERE place <= 3")
def exemplar_topk(spark, d):
    return th.exemplars(a_of(spark, d)).select("l5_id", "conversation_id", "place", "severity")


# --- text --------------------------------------------------------------------------------------------------------------------------------
@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '@[\p{L}\p{M}\p{N}\p{Pc}]+', '', 'g'), 'https?://[^\s\x{A0}\x{85}\x{2028}\x{2029}\x{3000}]+', '', 'g'), '[\s\x{0B}\x{A0}\x{85}\x{2028}\x{2029}\x{3000}]+', ' ', 'g')) AS text FROM documents""")
def text_clean(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '[ \t\n\x0B\f\r]*\|[ \t\n\x0B\f\r]*', chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, chr(2))) AS digest FROM p""")
def sentence_split(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\x02")).alias("digest"))


@query(r"""SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')), ['the', 'and', 'thin', 'license', 'und', 'que', 'zebra', 'x1']))::DOUBLE / 8, 6) AS score FROM documents""")
def keyword_overlap(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.round(text.overlap(F.col("text"), F.lit("The and thin license, und que zebra x1 the")), 6).alias("score"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), '[ \t\n\x0B\f\r]*\|[ \t\n\x0B\f\r]*', chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def _bm25_sql(source: str, keys: str, k: int, chars: int) -> str:
    """CTEs from ``source`` (keys, text, query) to ``snip`` (keys, snippet)."""
    using = f"USING ({keys})"
    return rf"""bq AS (SELECT {keys}, text, list_distinct(regexp_extract_all(lower(query), '[a-z0-9'']+')) AS q, {_SENTENCES.format(x="text")} AS s FROM {source}),
bx AS (SELECT {keys}, text, q, len(s) AS n, i, s[i] AS sent, regexp_extract_all(lower(s[i]), '[a-z0-9'']+') AS b FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM bq)),
bm AS (SELECT {keys}, greatest(sum(len(b))::DOUBLE / any_value(n), 1.0) AS m FROM bx GROUP BY {keys}),
btf AS (SELECT {keys}, i, tok, count(*) AS tf FROM (SELECT {keys}, i, unnest(b) AS tok FROM bx) GROUP BY ALL),
bdf AS (SELECT {keys}, tok, count(*) AS df FROM btf GROUP BY ALL),
bt AS (SELECT {keys}, i, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(b) / m))) AS score
  FROM bx JOIN bm {using} JOIN btf USING ({keys}, i) JOIN bdf USING ({keys}, tok) WHERE list_contains(q, tok) GROUP BY {keys}, i),
br AS (SELECT bx.*, coalesce(round(bt.score, 9), 0) AS score, row_number() OVER (PARTITION BY {", ".join("bx." + x.strip() for x in keys.split(","))} ORDER BY coalesce(round(bt.score, 9), 0) DESC, i) AS rk FROM bx LEFT JOIN bt USING ({keys}, i)),
bs AS (SELECT {keys}, max(score) AS best, string_agg(sent, ' ' ORDER BY i) FILTER (rk <= {k}) AS top, string_agg(sent, ' ' ORDER BY i) FILTER (i <= {k}) AS first FROM br GROUP BY {keys}),
snip AS (SELECT {keys}, substr(CASE WHEN len(s) <= {k} THEN trim(coalesce(text, '')) WHEN len(q) = 0 OR best <= 0 THEN first ELSE top END, 1, {chars}) AS snippet FROM bq LEFT JOIN bs {using})"""


@query(f"""WITH src AS (SELECT u.conv_id, u.turn, u.text, coalesce(n.text, '') AS query FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1), {_bm25_sql('src', 'conv_id, turn', 2, 500)}
SELECT conv_id, turn, snippet FROM snip""")
def bm25_scores(spark, d):
    """Every turn compressed by the one that answers it; the last of a conversation has no query."""
    c = ad.table(spark, d, "conversations")
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("q"))
    d = c.select("conv_id", "turn", "text").join(answer, ["conv_id", "turn"], "left").withColumn("q", F.coalesce("q", F.lit("")))
    return text.with_snippet(d, "text", F.col("q"), 2, 500).select("conv_id", "turn", "snippet")


def _tfidf_sql(select: str) -> str:
    stops = ", ".join(f"'{w}'" for w in th.stop_words())
    return rf"""WITH d AS (SELECT doc_id, source AS l5_id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^a-z\p{{L}}\p{{N}}_]+', '  ', 'g'), '(?:^| )([a-z]{{3,}})(?: |$)', 1), lambda x: x NOT IN ({stops})) AS w FROM documents),
g AS (SELECT doc_id, l5_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d),
tf AS (SELECT doc_id, l5_id, term, count(*) AS tf FROM (SELECT doc_id, l5_id, unnest(g) AS term FROM g) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.4 * n),
w AS (SELECT doc_id, l5_id, term, tf, (1 + ln(tf)) * idf AS raw FROM tf JOIN df USING (term)),
x AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w) {select}"""


@query(_tfidf_sql("SELECT l5_id, term, CAST(sum(tf) AS BIGINT) AS tf, round(sum(weight), 6) AS weight FROM x GROUP BY l5_id, term"))
def tfidf_terms(spark, d):
    return th.tfidf(ad.documents_a(spark, d)).groupBy("l5_id", "term").agg(F.sum("tf").alias("tf"), F.round(F.sum("weight"), 6).alias("weight"))


_W = r"[^\p{{L}}\p{{N}}_]"


@query(_tfidf_sql(rf""",
cls AS (SELECT source AS l5_id, count(*) AS n_cls, (SELECT n FROM n) AS n FROM documents GROUP BY source),
lt AS (SELECT l5_id, term, sum(weight) AS s FROM x GROUP BY l5_id, term), gt AS (SELECT term, sum(s) AS al FROM lt GROUP BY term),
dd AS (SELECT l5_id, term, n_cls, s / n_cls - coalesce((al - s) / nullif(n - n_cls, 0), 0) AS dist FROM lt JOIN gt USING (term) JOIN cls USING (l5_id) WHERE n_cls >= 15),
pl AS (SELECT *, row_number() OVER (PARTITION BY l5_id ORDER BY round(dist, 12) DESC, term) AS place FROM dd WHERE dist > 0),
tl AS (SELECT l5_id, any_value(n_cls) AS n_cls, list(term ORDER BY place) AS t FROM pl WHERE place <= 25 GROUP BY l5_id),
kl AS (SELECT l5_id, n_cls, list_reduce(t, lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: contains(z, y) OR contains(y, z))) > 0 THEN acc ELSE list_append(acc, y) END, CAST([] AS VARCHAR[])) AS t FROM tl),
kt AS (SELECT l5_id, n_cls, t[i] AS term, i AS place FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM kl)),
doc AS (SELECT CAST(d.doc_id AS VARCHAR) AS cid, source AS l5_id, text, 2.0::DOUBLE + 2 * coalesce(toxic, 0) + (1 - coalesce(quality, 1)) AS severity FROM documents d LEFT JOIN labels USING (doc_id)),
said AS (SELECT kt.*, cid, text, severity, row_number() OVER (PARTITION BY kt.l5_id, term ORDER BY severity DESC, cid DESC) AS r, count(*) OVER (PARTITION BY kt.l5_id, term) AS cnt
  FROM doc JOIN kt ON kt.l5_id = doc.l5_id AND regexp_matches(' ' || lower(text) || ' ', '{_W.format()}' || term || '{_W.format()}')),
th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l5_id ORDER BY place) AS nth FROM said WHERE r = 1 AND cnt >= 4) WHERE nth <= 5),
src AS (SELECT l5_id, term, text, term AS query FROM th), {_bm25_sql('src', 'l5_id, term', 1, 200)}
SELECT l5_id, term AS label, CAST(nth AS INT) AS place, cnt AS count, round(cnt::DOUBLE / n_cls, 6) AS share, snippet AS quote, severity FROM th JOIN snip USING (l5_id, term)"""))
def subthemes(spark, d):
    return th.subthemes(ad.documents_a(spark, d)).select("l5_id", "label", "place", "count", *r6("share"), "quote", "severity")


# --- threads, labels, samples --------------------------------------------------------------------------------------------------------------
@query("SELECT conv_id * 100000 + turn AS id, min(conv_id * 100000 + turn) OVER (PARTITION BY conv_id) AS root FROM conversations")
def thread_roots(spark, d):
    return threads.thread_roots(ad.replies(spark, d).select("id", "parent"))


@query(r"""SELECT conv_id * 100000 AS conversation_id, min(to_timestamp(1500000000 + conv_id * 100000 + turn)::TIMESTAMP) AS created_at,
  string_agg(t, ' | ' ORDER BY turn) FILTER (t <> '') AS text FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '@\w+', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id""")
def thread_text(spark, d):
    r = ad.replies(spark, d)
    roots = threads.thread_roots(r.select("id", "parent"))
    return threads.assemble(r, roots).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


_RAW = "CASE event_id % 7 WHEN 0 THEN ' Negative' WHEN 1 THEN 'POSITIVE ' WHEN 2 THEN 'very negative' WHEN 3 THEN 'very_positive' WHEN 4 THEN 'Neutral' WHEN 5 THEN 'meh' ELSE 'very_neg' END"


@query(f"""WITH r AS (SELECT event_id, lower(trim({_RAW})) AS k FROM events), m AS (SELECT event_id, CASE k WHEN 'negative' THEN 'neg' WHEN 'positive' THEN 'pos' WHEN 'very negative' THEN 'very_neg' WHEN 'very_positive' THEN 'pos' ELSE k END AS k FROM r)
SELECT event_id, CASE WHEN k IN ('very_neg', 'neg', 'neutral', 'pos') THEN k ELSE 'neg' END AS sentiment FROM m""")
def sentiment_normalise(spark, d):
    return ad.table(spark, d, "events").select("event_id", scores.normalise_sentiment(F.expr(_RAW)).alias("sentiment"))


_PACK = taxonomy.own_pack()
_LABEL = "CASE event_id % 6 WHEN 0 THEN 'post_sale__delivery__transit__delay__late_delivery' WHEN 1 THEN 'sale__refund_delayed' WHEN 2 THEN 'refund' WHEN 3 THEN 'nothing_like_it' WHEN 4 THEN 'x__charge' ELSE '' END"


@query(f"""WITH p AS (SELECT unnest({_PACK.ids()!r}) AS leaf, unnest(range({len(_PACK.ids())})) AS place), r AS (SELECT event_id, {_LABEL} AS raw FROM events),
l AS (SELECT DISTINCT raw FROM r WHERE raw <> ''), k AS (SELECT raw, leaf, place, CASE WHEN raw = leaf THEN 0 WHEN split_part(raw, '__', -1) = split_part(leaf, '__', -1) THEN 1 WHEN contains(leaf, split_part(raw, '__', -1)) THEN 2 END AS kind FROM l, p),
b AS (SELECT raw, arg_min(leaf, (kind, CASE WHEN kind = 2 THEN length(leaf) ELSE 0 END, place)) AS l5_id FROM k WHERE kind IS NOT NULL GROUP BY raw)
SELECT event_id, raw, l5_id FROM r LEFT JOIN b USING (raw)""")
def leaf_snap(spark, d):
    raw = ad.table(spark, d, "events").select("event_id", F.expr(_LABEL).alias("raw"))
    return taxonomy.snap_leaf(raw, _PACK.frame(spark)).select("event_id", "raw", "l5_id")


@query("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 1000")
def exact_sample(spark, d):
    return threads.exact_sample(ad.table(spark, d, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 5001 AND 10000")
def batch_slice(spark, d):
    return threads.batch_slice(ad.table(spark, d, "orders").select("o_orderkey"), 2, 5000, "o_orderkey")


# --- graph -----------------------------------------------------------------------------------------------------------------------------------
def nodes_of(spark, d):
    e = ad.table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.lit("vector").alias("type"), F.to_json(F.struct("label")).alias("props"), F.col("embedding"), F.lit(None).cast("string").alias("pack_version"), F.lit("0").alias("updated_at"))


@query("SELECT 'v' || vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, 1 LIMIT 10")
def vector_topk(spark, d):
    q = ad.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return gr.vector_search(nodes_of(spark, d), q, 10).select("id", F.round("score", 6).alias("score"))


@query("""SELECT 'v' || vec_id AS id, '{"label":' || CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END || '}' AS props, vec_id % 3 = 0 AS is_new FROM embeddings
UNION ALL SELECT 'w' || vec_id, '{"label":' || (label + 100) || '}', true FROM embeddings WHERE vec_id % 3 = 0""")
def graph_upsert(spark, d):
    old = nodes_of(spark, d)
    bump = lambda p: F.concat(F.lit('{"label":'), (F.get_json_object("props", "$.label").cast("long") + 100).cast("string"), F.lit("}"))
    third = old.where(F.substring("id", 2, 20).cast("long") % 3 == 0)
    new = third.withColumn("props", bump("props")).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("updated_at", F.lit("1"))
    new = new.unionByName(new.withColumn("id", F.concat(F.lit("w"), F.substring("id", 2, 20))))
    return gr.upsert_nodes(old, new).select("id", "props", (F.col("updated_at") == "1").alias("is_new"))


def nation_edges(spark, d):
    n, r, c = (ad.table(spark, d, t) for t in ("nation", "region", "customer"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("child_of").alias("type"), F.col("r_name").alias("dst"))
    buys = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("src"), F.lit("seen_in").alias("type"), F.col("n_name").alias("dst")).distinct()
    return up.unionByName(buys).select(gr.edge_id().alias("id"), "src", "type", "dst", F.lit("{}").alias("props"), F.lit("0").alias("updated_at"))


@query("""WITH RECURSIVE e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT 'BUILDING' AS id, 0 AS distance UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.id WHERE w.distance < 2) SELECT id, min(distance) AS distance FROM w GROUP BY id""")
def graph_traverse(spark, d):
    return gr.traverse(nation_edges(spark, d), "BUILDING", depth=3)[0]


@query("""WITH l AS (SELECT [r_name, n_name, c_mktsegment, 'group ' || c_custkey % 10, 'customer ' || c_custkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT array_to_string(path, '__') AS leaf, path, unnest(range(1, 5)) AS level FROM l)
SELECT DISTINCT CASE WHEN level = 4 THEN leaf ELSE 'l' || (level + 1) || ':' || path[level + 1] END AS child, 'l' || level || ':' || path[level] AS parent, CAST(level AS INT) AS level FROM s""")
def taxonomy_rollup(spark, d):
    """Customers as leaves below their region, nation, segment and group."""
    c, n, r = (ad.table(spark, d, t) for t in ("customer", "nation", "region"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    group = F.concat(F.lit("group "), (F.col("c_custkey") % 10).cast("string"))
    leaves = d.select(F.array("r_name", "n_name", "c_mktsegment", group, F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))).alias("path"))
    return taxonomy.parents(leaves.select(F.array_join("path", "__").alias("l5_id"), "path")).select("child", "parent", "level").distinct()


def memory_graph(spark, d):
    """Period metrics of the order domain as nodes and edges."""
    w = me.weekly_metrics(a_of(spark, d))
    key = F.concat_ws("@", "l5_id", "week")
    nodes = w.select(key.alias("id"), F.lit("period_metric").alias("type"), F.to_json(F.struct("l5_id", "week", "volume")).alias("props"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("pack_version"), F.lit("0").alias("updated_at"))
    edges = w.select(F.concat_ws(":", F.col("l5_id"), F.lit("measured_in"), key).alias("id"), F.col("l5_id").alias("src"), F.lit("measured_in").alias("type"), key.alias("dst"), F.lit("{}").alias("props"), F.lit("0").alias("updated_at"))
    return gr.Graph(nodes, edges, spark.createDataFrame([], gr.RUN))


@query(f"WITH {_A}, {_WEEKLY} SELECT l5_id || '@' || week AS id, week, volume FROM weekly WHERE l5_id = '1-URGENT'")
def read_memory(spark, d):
    from .plans import reads

    return reads.period_series(memory_graph(spark, d), "1-URGENT").select("id", "week", "volume")


@query(f"""{_NOVALUE} SELECT l5_id, {_TIER.format(x='round(egregiousness, 4)')} AS importance, 'new' AS movement, round(egregiousness, 4) AS egregiousness, total_volume AS volume FROM egreg JOIN stats USING (l5_id)""")
def curated_set(spark, d):
    from .plans import reads

    s = _scores(spark, d).join(me.window_stats(a_of(spark, d)), "l5_id")
    path = F.array(*(F.lit(x) for x in "abcd"), F.col("l5_id"))
    score = F.round("egregiousness", 4)
    props = F.to_json(F.struct("l5_id", path.alias("path"), "total_volume", score.alias("latest_egregiousness"), scores.tier(score).alias("importance")))
    nodes = s.select(F.col("l5_id").alias("id"), F.lit("pain_point").alias("type"), props.alias("props"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("pack_version"), F.lit("0").alias("updated_at"))
    g = gr.Graph(nodes, spark.createDataFrame([], gr.EDGE), spark.createDataFrame([], gr.RUN))
    return reads.curated_set(g).select("l5_id", "importance", "movement", "egregiousness", "volume")


@query(f"""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS conversation_id, l_returnflag || '-' || l_linestatus || '-' || p_type AS l5_id, p_brand, n_name AS s_nation, r_name AS region, c_mktsegment, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
{_cells("l", ad.LINE_DIMENSIONS, "(SELECT * EXCLUDE (l5_id) FROM l)")} SELECT {_CELLCOLS}, round(p_value, 6) AS p_value, significant FROM edges""")
def line_drivers(spark, d):
    merged = dr.merge(ad.lines_a(spark, d), ad.lines_b(spark, d), ad.LINE_DIMENSIONS)
    return dr.drivers(merged, ad.LINE_DIMENSIONS, "all").select("l5_id", "dimension", "value", "support", *r6("share", "lift", "p_value"), "significant")


