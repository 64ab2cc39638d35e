"""Queries over a graph that was built and read back, and over what feeds it; the same in DuckDB SQL from the base tables.

The graph is the work of two runs of the build on orders, tagged with leaves of the library's taxonomy and with planted dimensions:
one over the older orders, one over all. It is built once a session and directory, into the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from . import contract, folders
from . import queries as own
from .config import DEFAULT
from .functions import scores
from .operators import drivers as dr
from .plans import build, reads, report
from .plans import graph as gr
from .queries import _EGREG, _STATS, _WEEKLY, _Z, LEAVES, PLANT_DIMS, _bm25_sql, _cells, _pick_sql, query
from .sources import files, planted, tagger, taxonomy

PACK = taxonomy.own_pack()
IDS = [next(i for i in PACK.ids() if i.endswith(x)) for x in LEAVES]
LATE = IDS[0]
OLDER = "1996-01-01"


def shared_folder(spark: SparkSession) -> str:
    return f"{folders.shared(spark)}/{uuid.uuid4().hex}"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    a = own.planted_a(spark, d)
    leaf = F.element_at(F.lit(IDS), (F.col("conversation_id").cast("long") % len(IDS) + 1).cast("int"))
    about = F.replace(F.element_at(F.split(leaf, "__"), -1), F.lit("_"), F.lit(" "))
    text = F.concat(F.lit("Contact "), "conversation_id", F.lit(" is about "), about, F.lit(". It was "), "sentiment", F.lit(". Please charge nothing before the promised date."))
    return a.drop("severity").withColumn("l5_id", leaf).withColumn("text", text)


_BUILT: dict[tuple[str, str], tuple[gr.Store, list]] = {}


def built(spark: SparkSession, d: str) -> tuple[gr.Store, list]:
    """The store after both runs, and the results of these."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        store, a = gr.Store(spark, shared_folder(spark)), tagged(spark, d)
        b = planted.plant(a, facts=False)
        older = a.where(F.col("created_at") < F.lit(OLDER).cast("timestamp"))
        _BUILT[key] = store, [build.run(older, b, store, "run1", "t1", PACK), build.run(a, b, store, "run2", "t2", PACK)]
    return _BUILT[key]


def graph_of(spark: SparkSession, d: str) -> gr.Graph:
    return built(spark, d)[0].read()


# --- SQL of the two runs ----------------------------------------------------------------------------------------------------------
_LEAF = f"list_extract({IDS!r}, CAST(o_orderkey % {len(IDS)} AS INT) + 1)"
_GPICK = ", ".join(f"{_pick_sql(x, IDS)} AS {x}" for x in PLANT_DIMS)
_THIRD = DEFAULT.weight_value / 3
_GEGREG = _EGREG.replace("0.4::DOUBLE * pct_volume + 0.3::DOUBLE * pct_severity + 0.3::DOUBLE * pct_spike", " + ".join(f"{w + _THIRD!r}::DOUBLE * {c}" for w, c in ((DEFAULT.weight_volume, "pct_volume"), (DEFAULT.weight_severity, "pct_severity"), (DEFAULT.weight_spike, "pct_spike"))))


def _run(where: str = "true") -> str:
    a = own._A.replace("o_orderpriority AS l5_id", f"{_LEAF} AS l5_id").replace("FROM orders)", f"FROM orders WHERE {where})")
    return f"""{a}, {_WEEKLY}, {_Z}, {_STATS.format(value='0.0::DOUBLE', a='a')}, {_GEGREG}, pb AS (SELECT conversation_id, {_GPICK} FROM a), {_cells('a', PLANT_DIMS, 'pb')},
  {own._SYS}, sys AS (SELECT *, n_significant * mean_lift / max(n_significant * mean_lift) OVER () AS systemic_score FROM sy),
  leafs(l5_id, path, definition) AS (VALUES {", ".join(f"('{i}', '{'/'.join(PACK.path(i))}', '{PACK.definition(i)}')" for i in PACK.ids())}),
  pp AS (SELECT stats.*, z.zscore, z.latest_week, egregiousness, {own._TIER.format(x='egregiousness')} AS importance,
    CASE WHEN zscore >= 2 THEN 'rising' WHEN zscore <= -1 THEN 'falling' ELSE 'stable' END AS trend FROM stats JOIN z USING (l5_id) JOIN egreg USING (l5_id)),
  period AS (SELECT max(week) AS period FROM weekly),
  tops AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY l5_id ORDER BY lift DESC, dimension, value) AS nth FROM edges WHERE significant),
  claims AS (SELECT *, dimension || '=' || value || ' over-indexes for ' || l5_id || ' (lift ' || round(lift, 2) || 'x, n=' || support || ')' AS claim FROM tops WHERE nth <= 3),
  fac AS (SELECT l5_id, dimension, value, round(share, 3) AS share, round(lift, 2) AS lift, row_number() OVER (PARTITION BY l5_id, dimension ORDER BY edges.share DESC, value) AS nth FROM edges QUALIFY nth <= 3 AND edges.share >= 0.05)"""


_G, _G1 = f"WITH {_run()}", f"WITH {_run(f'''o_orderdate < TIMESTAMP '{OLDER}' ''')}"
_TEXT = """'Contact ' || conversation_id || ' is about ' || replace(string_split(l5_id, '__')[-1], '_', ' ') || '. It was ' || sentiment || '. Please charge nothing before the promised date.'"""
_EX = f"""ex AS (SELECT *, {_TEXT} AS text FROM (SELECT *, row_number() OVER (PARTITION BY l5_id ORDER BY severity DESC, conversation_id) AS place FROM a) WHERE place <= 3),
  src AS (SELECT ex.l5_id, conversation_id, text, definition AS query FROM ex JOIN leafs USING (l5_id)), {_bm25_sql("src", "l5_id, conversation_id", 2, 500)},
  exs AS (SELECT l5_id, conversation_id, snippet, severity, sentiment FROM ex JOIN snip USING (l5_id, conversation_id))"""


# --- what the build writes --------------------------------------------------------------------------------------------------------
@query(f"""{_G} SELECT l5_id, path, definition, total_volume, round(severity_avg, 3) AS severity_avg, round(zscore, 3) AS zscore, round(egregiousness, 4) AS egregiousness, importance, trend, period AS last_seen
FROM pp JOIN leafs USING (l5_id), period""")
def build_pain_points(spark, d):
    p = reads.leaves(graph_of(spark, d))
    return p.select("l5_id", F.array_join("path", "/").alias("path"), "definition", "total_volume", "severity_avg", F.col("latest_zscore").alias("zscore"), F.col("latest_egregiousness").alias("egregiousness"), "importance", "trend", "last_seen")


@query(f"""{_G}, w AS (SELECT * FROM weekly, period WHERE week = period UNION BY NAME (WITH {_run(f"o_orderdate < TIMESTAMP '{OLDER}'")} SELECT * FROM weekly, period WHERE week = period))
SELECT l5_id || '@' || week AS id, l5_id, week, volume, round(severity_avg, 3) AS severity_avg, round(sentiment_avg, 3) AS sentiment_avg FROM w""")
def build_period_metrics(spark, d):
    n = graph_of(spark, d).nodes.where("type = 'period_metric'")
    return n.select("id", F.from_json("props", "l5_id string, week string, volume bigint, severity_avg double, sentiment_avg double").alias("p")).select("id", "p.*")


@query(f"""{_G}, e AS (SELECT l5_id, week, zscore FROM weekly JOIN z USING (l5_id), period WHERE week = period UNION ALL (WITH {_run(f"o_orderdate < TIMESTAMP '{OLDER}'")} SELECT l5_id, week, zscore FROM weekly JOIN z USING (l5_id), period WHERE week = period))
SELECT l5_id AS src, 'measured_in' AS type, l5_id || '@' || week AS dst FROM e UNION SELECT l5_id, 'spiked_in', l5_id || '@' || week FROM e WHERE zscore >= 2""")
def build_period_edges(spark, d):
    return graph_of(spark, d).edges.where("type IN ('measured_in', 'spiked_in')").select("src", "type", "dst")


@query(f"""{_G} SELECT 'dim:' || dimension || ':' || value AS id, n_significant, array_to_string(leaves, ',') AS leaves, total_support, round(mean_lift, 3) AS mean_lift, round(max_lift, 3) AS max_lift,
  n_significant >= 3 AS is_bridge, n_significant = 1 AS is_singleton, round(systemic_score, 4) AS systemic_score FROM sys""")
def build_dimensions(spark, d):
    n = graph_of(spark, d).nodes.where("type = 'dimension' AND updated_at = 't2'")
    p = n.select("id", F.from_json("props", reads._DIM).alias("p")).select("id", "p.*").where("n_significant_l5 > 0")
    return p.select("id", F.col("n_significant_l5").alias("n_significant"), F.array_join("affected_l5s", ",").alias("leaves"), "total_support", "mean_lift", "max_lift", "is_bridge", "is_singleton", "systemic_score")


@query(f"""{_G}, o AS (WITH {_run(f"o_orderdate < TIMESTAMP '{OLDER}'")} SELECT l5_id, dimension, value FROM edges)
SELECT l5_id AS src, 'dim:' || dimension || ':' || value AS dst, support, round(share, 4) AS share, round(lift, 4) AS lift, significant, round(excess, 2) AS excess, period,
  CAST(1 + (o.l5_id IS NOT NULL)::INT AS INT) AS n_history FROM edges LEFT JOIN o USING (l5_id, dimension, value), period""")
def build_affects(spark, d):
    e = graph_of(spark, d).edges.where("type = 'affects' AND updated_at = 't2'")
    p = e.select("src", "dst", F.from_json("props", reads._AFFECTS).alias("p"))
    return p.select("src", "dst", "p.support", "p.share", "p.lift", "p.significant", "p.excess", "p.period", F.size("p.history").alias("n_history"))


@query(f"{_G} SELECT 'verification:' || substr(sha1(l5_id || '|' || claim), 1, 12) AS id, l5_id, claim, CASE WHEN lift > 1 AND support >= 30 THEN 'verified' ELSE 'unsupported' END AS verdict FROM claims")
def build_verifications(spark, d):
    n = graph_of(spark, d).nodes.where("type = 'verification' AND updated_at = 't2'")
    return n.select("id", F.from_json("props", "l5_id string, claim string, verdict string").alias("p")).select("id", "p.*")


@query(f"""{_G}, c AS (SELECT 'verification:' || substr(sha1(l5_id || '|' || claim), 1, 12) AS src, l5_id, 'dim:' || dimension || ':' || value AS dim FROM claims)
SELECT src, 'verifies' AS type, l5_id AS dst FROM c UNION ALL SELECT src, 'cites', dim FROM c""")
def build_citations(spark, d):
    return graph_of(spark, d).edges.where("type IN ('verifies', 'cites') AND updated_at = 't2'").select("src", "type", "dst")


@query(f"{_G}, {_EX} SELECT 'exemplar:' || conversation_id AS id, l5_id, snippet, severity, sentiment FROM exs")
def build_exemplars(spark, d):
    n = graph_of(spark, d).nodes.where("type = 'exemplar' AND updated_at = 't2'")
    return n.select("id", F.from_json("props", reads._EXEMPLAR).alias("p")).select("id", "p.l5_id", "p.snippet", "p.severity", "p.sentiment")


@query(f"""WITH l AS (SELECT unnest({IDS!r}) AS leaf), s AS (SELECT leaf, string_split(leaf, '__') AS path, unnest(range(1, 5)) AS level FROM l)
SELECT DISTINCT CASE WHEN level = 4 THEN leaf ELSE 'l' || (level + 1) || ':' || path[level + 1] END AS src, 'l' || level || ':' || path[level] AS dst, 'pain_point' AS parent_type FROM s""")
def build_rollup(spark, d):
    g = graph_of(spark, d)
    return g.edges.where("type = 'child_of'").join(g.nodes.select(F.col("id").alias("dst"), F.col("type").alias("parent_type")), "dst").select("src", "dst", "parent_type")


@query(f"""SELECT * FROM ({_G} SELECT 'run2' AS run_id, period AS "window", (SELECT count(*) FROM a) AS n, '1' AS pack_version, 't2' AS created_at FROM period)
UNION ALL SELECT * FROM ({_G1} SELECT 'run1', period, (SELECT count(*) FROM a), '1', 't1' FROM period)""")
def build_runs(spark, d):
    return reads.list_runs(graph_of(spark, d))


@query(f"""{_G} SELECT (SELECT count(*) FROM a) AS n_transcripts, (SELECT count(*) FROM pp) AS n_l5, (SELECT count(*) FROM edges) AS n_driver_edges, (SELECT count(*) FROM edges WHERE significant) AS n_significant,
  (SELECT count(*) FROM sys WHERE n_significant >= 3) AS n_bridges, (SELECT count(*) FROM claims) AS n_verifications, (SELECT string_agg(l5_id, ',' ORDER BY egregiousness DESC, l5_id) FROM pp) AS top_egregious""")
def run_summary(spark, d):
    s = built(spark, d)[1][1].summary
    row = (s["n_transcripts"], s["n_l5"], s["n_driver_edges"], s["n_significant_drivers"], s["n_bridges"], s["n_verifications"], ",".join(s["top_egregious"]))
    return spark.createDataFrame([row], "n_transcripts long, n_l5 long, n_driver_edges long, n_significant long, n_bridges long, n_verifications long, top_egregious string")


@query(f"""WITH n AS ({_G}, {_EX} SELECT 1 AS k, count(*) AS c FROM exs)
SELECT 'runs' AS name, 2::BIGINT AS rows UNION ALL SELECT 'exemplar', (SELECT count(*) FROM (SELECT conversation_id FROM ({_G}, {_EX} SELECT conversation_id FROM exs) UNION SELECT conversation_id FROM ({_G1}, {_EX} SELECT conversation_id FROM exs)))""")
def snapshot_sink(spark, d):
    """The snapshot read back from its JSON lines: runs and exemplars."""
    at = built(spark, d)[0].snapshot("s1")
    n = spark.read.schema(gr.NODE).json(f"{at}/nodes").where("type = 'exemplar'").agg(F.lit("exemplar").alias("name"), F.count("*").alias("rows"))
    return n.unionByName(spark.read.schema(gr.RUN).json(f"{at}/runs").agg(F.lit("runs").alias("name"), F.count("*").alias("rows")))


# --- reads ------------------------------------------------------------------------------------------------------------------------
@query(f"""{_G} SELECT ranking, l5_id, place FROM (
  SELECT 'egregiousness' AS ranking, l5_id, row_number() OVER (ORDER BY round(egregiousness, 4) DESC, l5_id) AS place FROM pp UNION ALL
  SELECT 'zscore', l5_id, row_number() OVER (ORDER BY round(zscore, 3) DESC, l5_id) FROM pp UNION ALL
  SELECT 'volume', l5_id, row_number() OVER (ORDER BY total_volume DESC, l5_id) FROM pp) WHERE place <= 3""")
def read_top_leaves(spark, d):
    from pyspark.sql import Window

    g, out = graph_of(spark, d), None
    for by, key in (("egregiousness", "latest_egregiousness"), ("zscore", "latest_zscore"), ("volume", "total_volume")):
        place = F.row_number().over(Window.orderBy(F.desc(key), "l5_id")).cast("long").alias("place")  # of three rows
        one = reads.top_leaves(g, by, 3).select(F.lit(by).alias("ranking"), "l5_id", place)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_G} SELECT l5_id, round(zscore, 3) AS zscore FROM pp WHERE round(zscore, 3) >= -3")
def read_spikes(spark, d):
    return reads.spikes(graph_of(spark, d), -3.0).select("l5_id", F.col("latest_zscore").alias("zscore"))


@query(f"{_G} SELECT dimension, value, round(lift, 4) AS lift, support FROM edges WHERE significant AND l5_id = '{LATE}'")
def read_drivers(spark, d):
    return reads.drivers_of(_current(spark, d), LATE, significant_only=True).select("dimension", "value", "lift", "support")


def _current(spark: SparkSession, d: str) -> gr.Graph:
    """The graph as of its newest run."""
    return reads.as_of(graph_of(spark, d))


@query(f"{_G} SELECT dimension, value, place, l5_id, support FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY dimension, value ORDER BY support DESC, l5_id) AS place FROM edges WHERE dimension = 'carrier') WHERE place <= 2")
def read_hotspots(spark, d):
    h = reads.ops_hotspots(_current(spark, d), "carrier", 2).select("dimension", "value", F.explode("leaves").alias("x"))
    return h.select("dimension", "value", F.col("x.place").cast("long").alias("place"), "x.l5_id", "x.support")


@query(f"""SELECT conversation_id, severity FROM (SELECT * FROM ({_G}, {_EX} SELECT conversation_id, severity FROM exs WHERE l5_id = '{LATE}') UNION SELECT * FROM ({_G1}, {_EX} SELECT conversation_id, severity FROM exs WHERE l5_id = '{LATE}'))
ORDER BY severity DESC, conversation_id LIMIT 2""")
def read_exemplars(spark, d):
    return reads.exemplars_of(graph_of(spark, d), LATE, 2).select("conversation_id", "severity")


@query(f"{_G} SELECT dimension, value, row_number() OVER (ORDER BY n_significant >= 3 DESC, round(systemic_score, 4) DESC, dimension, value) AS place FROM sys QUALIFY place <= 5")
def read_systemic(spark, d):
    from pyspark.sql import Window

    g = _current(spark, d)
    place = F.row_number().over(Window.orderBy(F.desc("is_bridge"), F.desc("systemic_score"), "dimension", "value")).cast("long").alias("place")  # of five rows
    return reads.systemic_drivers(g, k=5).select("dimension", "value", place)


@query(f"{_G} SELECT l5_id, true AS found, path, total_volume, importance FROM pp JOIN leafs USING (l5_id) WHERE l5_id = '{LATE}' UNION ALL SELECT 'nothing', false, NULL, NULL, NULL")
def read_profile(spark, d):
    g = graph_of(spark, d)
    both = reads.leaf_profile(g, LATE).unionByName(reads.leaf_profile(g, "nothing"))
    return both.select("l5_id", "found", F.array_join("path", "/").alias("path"), "total_volume", "importance")


@query(f"""{_G}, c AS (SELECT l5_id, dimension, value, lift, support, significant FROM edges UNION ALL SELECT '{LATE}', 'carrier', 'Nobody', NULL, NULL, NULL)
SELECT l5_id, dimension, value, CASE WHEN significant AND round(lift, 4) > 1 AND support >= 30 THEN 'verified' ELSE 'unsupported' END AS verdict, CASE WHEN support IS NULL THEN 'no edge' END AS reason FROM c""")
def read_verify(spark, d):
    g = _current(spark, d)
    claims = reads.affects(g).select("l5_id", "dimension", "value").unionByName(spark.createDataFrame([(LATE, "carrier", "Nobody")], "l5_id string, dimension string, value string"))
    return reads.verify_claims(g, claims).select("l5_id", "dimension", "value", "verdict", "reason")


@query(f"""{_G}, e AS (SELECT * FROM ({_G}, {_EX} SELECT * FROM exs) UNION SELECT * FROM ({_G1}, {_EX} SELECT * FROM exs)),
q AS (SELECT *, round(len(list_intersect(list_distinct(regexp_extract_all(lower(snippet), '[a-z0-9'']+')), ['late', 'payment', 'zebra', 'contact']))::DOUBLE / 4, 3) AS match_score FROM e)
SELECT conversation_id, match_score FROM q WHERE match_score > 0 ORDER BY match_score DESC, severity DESC, conversation_id LIMIT 7""")
def read_search(spark, d):
    return reads.search(graph_of(spark, d), "late payment zebra contact", k=7).select("conversation_id", "match_score")


@query(f"""SELECT 'insight:run2:{LATE}:' || substr(sha1('many|carrier|call'), 1, 8) AS id, 'many' AS summary, 'carrier' AS cause, type, dst FROM (VALUES ('explains', '{LATE}'), ('cites', 'dim:carrier:USPS'), ('cites', 'dim:region:West')) t(type, dst)""")
def write_insight(spark, d):
    g = reads.write_insight(graph_of(spark, d), LATE, "run2", "many", "carrier", "call", ["dim:carrier:USPS", "dim:region:West"], "t3")
    return reads.insights_of(g, LATE).join(g.edges.select(F.col("src").alias("id"), "type", "dst"), "id").select("id", "summary", "cause", "type", "dst")


@query(f"""WITH n AS ({_G} SELECT * FROM pp), o AS ({_G1} SELECT l5_id, importance, total_volume FROM pp)
SELECT n.l5_id, n.importance, o.importance AS importance_prev, CASE WHEN o.importance IS NULL THEN 'new' WHEN rn > ro THEN 'escalated' WHEN rn < ro THEN 'de-escalated' ELSE 'stable' END AS movement, n.trend,
  n.total_volume AS volume, n.total_volume - o.total_volume AS volume_delta, round(n.zscore, 3) AS zscore
FROM (SELECT *, list_position(['low', 'fair', 'high', 'very_high'], importance) AS rn FROM n) n LEFT JOIN (SELECT *, list_position(['low', 'fair', 'high', 'very_high'], importance) AS ro FROM o) o USING (l5_id)""")
def read_curated(spark, d):
    return reads.curated_set(graph_of(spark, d)).select("l5_id", "importance", "importance_prev", "movement", "trend", "volume", "volume_delta", "zscore")


@query(f"{_G} SELECT importance, count(*) AS count FROM pp GROUP BY importance")
def read_tiers(spark, d):
    return reads.tier_counts(graph_of(spark, d))


@query(f"""{_G}, o AS (WITH {_run(f"o_orderdate < TIMESTAMP '{OLDER}'")} SELECT dimension, value, support, period FROM edges, period WHERE l5_id = '{LATE}')
SELECT dimension, value, edges.support, o.support AS before, o.period AS period_before FROM edges JOIN o USING (dimension, value) WHERE l5_id = '{LATE}'""")
def read_trends(spark, d):
    """Driver trends of a leaf: the entry of the run before beside that of now."""
    t = reads.memory(_current(spark, d), LATE)["trends"].where(F.size("history") == 2)
    return t.select("dimension", "value", "support", F.col("history")[0]["support"].alias("before"), F.col("history")[0]["period"].alias("period_before"))


@query(f"{_G} SELECT l5_id, dimension, value, share, lift FROM fac WHERE nth = 1 AND share >= 0.15 AND lift >= 1.3 QUALIFY row_number() OVER (PARTITION BY l5_id ORDER BY lift DESC, list_position({list(report.PRIORITY)!r}, dimension)) <= 5")
def report_composition(spark, d):
    rows = [(c["l5_id"], *x) for c in report.data(graph_of(spark, d), "run2")["curated"] for x in c["composition"]]
    return spark.createDataFrame(rows, "l5_id string, dimension string, value string, share double, lift double")


@query(f"""{_G} SELECT 'curated' AS section, (SELECT count(*) FROM pp) AS n UNION ALL SELECT 'bridges', least(8, (SELECT count(*) FROM sys WHERE n_significant >= 3)) UNION ALL SELECT 'spikes', (SELECT count(*) FROM pp WHERE round(zscore, 3) >= 2)
UNION ALL SELECT 'drivers', (SELECT count(*) FROM tops WHERE nth <= 5) UNION ALL SELECT 'lines', (SELECT count(*) FROM pp)""")
def report_sections(spark, d):
    """How much each section of the report holds; ``lines`` are the leaves that the Markdown gives a heading."""
    data = report.data(_current(spark, d), "run2")
    n = {s: len(data[s]) for s in ("curated", "bridges", "spikes")}
    n |= {"drivers": sum(len(c["top_drivers"]) for c in data["curated"]), "lines": report.markdown(data).count("\n### ")}
    return spark.createDataFrame(list(n.items()), "section string, n long")


# --- graph primitives -------------------------------------------------------------------------------------------------------------
_NE = "e AS (SELECT n_name AS src, 'child_of' AS type, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_mktsegment, 'seen_in', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("SELECT 'v' || vec_id AS id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 5")
def graph_query(spark, d):
    n = own.nodes_of(spark, d).withColumn("props", F.to_json(F.struct(F.get_json_object("props", "$.label").cast("long").alias("label"), (-F.substring("id", 2, 20).cast("long")).alias("rank"))))
    return gr.query(n, "vector", {"label": 3}, order_by="rank", limit=5).select("id", gr.prop("label").cast("int").alias("label"))


@query("SELECT 'v' || vec_id AS id, label FROM embeddings WHERE vec_id = 7")
def graph_get_node(spark, d):
    return gr.get_node(own.nodes_of(spark, d), "v7").select("id", gr.prop("label").cast("int").alias("label"))


@query(f"WITH {_NE} SELECT 'out' AS direction, src, type, dst FROM e WHERE src = 'BUILDING' UNION ALL SELECT 'in', * FROM e WHERE dst = 'ASIA' UNION ALL SELECT 'both', * FROM e WHERE type = 'child_of' AND (src = 'CHINA' OR dst = 'CHINA')")
def graph_get_edges(spark, d):
    e = own.nation_edges(spark, d)
    asked = (("out", "BUILDING", None), ("in", "ASIA", None), ("both", "CHINA", "child_of"))
    out = [gr.get_edges(e, n, way, kind).select(F.lit(way).alias("direction"), "src", "type", "dst") for way, n, kind in asked]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_NE} SELECT src || ':' || type || ':' || dst AS id, CASE WHEN type = 'child_of' THEN '{{\"n\":2}}' ELSE '{{}}' END AS props FROM e UNION ALL SELECT 'BUILDING:child_of:ASIA', '{{\"n\":2}}'")
def graph_add_edge(spark, d):
    e = own.nation_edges(spark, d)
    new = e.where("type = 'child_of'").unionByName(spark.createDataFrame([("", "BUILDING", "child_of", "ASIA", "{}", "0")], e.schema)).withColumn("props", F.lit('{"n":2}'))
    return gr.upsert_edges(e, new.drop("id")).select("id", "props")


@query(f"WITH {_NE}, near AS (SELECT 'BUILDING' AS id UNION SELECT dst FROM e WHERE src = 'BUILDING') SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM near)")
def graph_traverse_edges(spark, d):
    return gr.traverse(own.nation_edges(spark, d), "BUILDING", depth=2)[1].select("src", "type", "dst")


@query("WITH p AS (SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p")
def graph_co_occurs(spark, d):
    a = ad.table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"))
    b = a.select("n_regionkey", F.col("ka").alias("kb"), F.col("a").alias("b"))
    return gr.co_occurs(a.join(b, "n_regionkey").where("ka < kb").select("a", "b"), "1").select("src", "dst")


# --- contract, scores, tags, sources ------------------------------------------------------------------------------------------------
@query("""SELECT * FROM (VALUES ('a columns', 'Table A: missing required columns: [''churn_intent'']'), ('b id', 'Table B: missing required columns: [''conversation_id'']'), ('b alone', 'Table B: no column besides conversation_id'),
  ('b declared', 'Table B: declared dimension columns are missing: [''vendor'']'), ('b dimensions', 'Table B: no categorical dimension columns detected'), ('join', 'Table A and Table B share no conversation_id')) t("check", message)""")
def contract_errors(spark, d):
    """What each check of whole tables says of a table that breaks it."""
    a, b = own.a_of(spark, d), ad.orders_b(spark, d)
    cases = {
        "a columns": lambda: contract.validate_table_a(a.drop("churn_intent")), "b id": lambda: contract.validate_table_b(b.drop("conversation_id")),
        "b alone": lambda: contract.validate_table_b(b.select("conversation_id")), "b declared": lambda: contract.validate_table_b(b, ["nation", "vendor"]),
        "b dimensions": lambda: contract.validate_table_b(b.select("conversation_id", "order_total")),
        "join": lambda: contract.validate_join(a, b.withColumn("conversation_id", F.concat(F.lit("x"), "conversation_id"))),
    }
    rows = []
    for name, check in cases.items():
        try:
            check()
        except contract.ContractError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "check string, message string")


@query("SELECT count(*) AS n, 'c_mktsegment,nation,region,order_status' AS dimensions FROM orders")
def contract_validate(spark, d):
    a, dims = contract.validate(own.a_of(spark, d), ad.orders_b(spark, d))
    return a.agg(F.count("*").alias("n"), F.lit(",".join(dims)).alias("dimensions"))


@query(f"WITH {own._A} SELECT conversation_id, 'full' AS given, 1 + (CAST(conversation_id AS BIGINT) % 5)::DOUBLE AS severity FROM a UNION ALL SELECT conversation_id, 'gaps', severity FROM a")
def severity_given(spark, d):
    """A severity column counts where every row has one; with a gap the rubric counts for all."""
    a = ad.orders_a(spark, d)
    five = (F.col("conversation_id").cast("long") % 5 + 1).cast("double")
    full = scores.with_severity(a.withColumn("severity", five)).select("conversation_id", F.lit("full").alias("given"), "severity")
    gaps = scores.with_severity(a.withColumn("severity", F.when(five > 1, five))).select("conversation_id", F.lit("gaps").alias("given"), "severity")
    return full.unionByName(gaps)


_U = "(CAST('0x' || substr(md5(conversation_id || '|{n}|42'), 1, 12) AS BIGINT)::DOUBLE / " + repr(float(1 << 48)) + ")"
_N = "sqrt(-2 * ln(1 - " + _U.replace("{n}", "{n}/a") + ")) * cos(2 * pi() * " + _U.replace("{n}", "{n}/b") + ")"


@query(f"""WITH {own._A} SELECT conversation_id, round(CASE WHEN financial_harm > 0 THEN 250 + 50 * {_N.format(n="order_total")} ELSE 120 + 30 * {_N.format(n="order_total")} END, 6) AS order_total,
  CAST(1 + floor(20 * {_U.format(n="quantity")}) AS INT) AS quantity, round(2880 + 864 * {_N.format(n="delivery_minutes")}, 6) AS delivery_minutes FROM a""")
def planted_facts(spark, d):
    return planted.plant(own.a_of(spark, d), [], facts=True).select("conversation_id", F.round("order_total", 6).alias("order_total"), "quantity", F.round("delivery_minutes", 6).alias("delivery_minutes"))


_KNOWN = [(i, leaf, sorted({w for w in f"{n['definition']} {n['path'][-1].replace('_', ' ')}".lower().replace(",", " ").split() if len(w) > 3})) for i, (leaf, n) in enumerate(PACK.nodes.items())]
_HAS = ", ".join(f"({i}, '{leaf}', {w!r})" for i, leaf, w in _KNOWN)
_TAGS = f"""c AS (SELECT CAST(conv_id * 100000 + turn AS VARCHAR) AS conversation_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, turn FROM conversations),
  w(i, leaf, words) AS (VALUES {_HAS}),
  s AS (SELECT conversation_id, leaf, len(list_filter(words, lambda x: contains(low, x))) AS n, i FROM c, w),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY n DESC, i) = 1),
  t AS (SELECT c.*, leaf, n, CASE WHEN regexp_matches(low, '{tagger.VERY_NEGATIVE}') THEN 'very_neg' WHEN regexp_matches(low, '{tagger.NEGATIVE}') THEN 'neg' WHEN regexp_matches(low, '{tagger.POSITIVE}') THEN 'pos' ELSE 'neutral' END AS sentiment,
    {", ".join(f"regexp_matches(low, '{p}')::INT AS {s}" for s, p in tagger.SIGNAL_CUES.items())}, CASE WHEN n > 0 THEN 0.5 ELSE 0.1 END::DOUBLE AS confidence FROM c JOIN b USING (conversation_id))"""
_SIGNALS = ", ".join(tagger.SIGNAL_CUES)


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).cast("string").alias("conversation_id"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {_TAGS} SELECT conversation_id, leaf AS l5_id, sentiment, {_SIGNALS}, confidence FROM t")
def tag_rules(spark, d):
    return tagger.tag_conversations(_contacts(spark, d), PACK)[0].select("conversation_id", "l5_id", "sentiment", *tagger.SIGNAL_CUES, "confidence")


@query(f"""WITH {_TAGS}, h AS (SELECT *, turn % 2 = 0 AS hit FROM t)
SELECT conversation_id, CASE WHEN hit THEN leaf ELSE '{PACK.ids()[0]}' END AS l5_id, CASE WHEN hit THEN sentiment ELSE 'neg' END AS sentiment, CASE WHEN hit THEN unresolved ELSE 1 END AS unresolved, CASE WHEN hit THEN confidence ELSE 0 END::DOUBLE AS confidence FROM h""")
def tag_cache(spark, d):
    """Even turns come out of the cache; the tagger leaves the others out, so they get the fallback tag."""

    class Silent:
        def tag(self, conversations, pack):
            return tagger.RuleTagger().tag(conversations, pack).limit(0)

    c = _contacts(spark, d)
    known = tagger.tag_conversations(c.where(F.col("conversation_id").cast("long") % 100000 % 2 == 0), PACK)[1]
    return tagger.tag_conversations(c, PACK, Silent(), known)[0].select("conversation_id", "l5_id", "sentiment", "unresolved", "confidence")


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'order|deliver|ship|track|return|refund|charge|cancel') THEN 'post_sale' WHEN regexp_matches(lower(text), 'purchase|buy|checkout|cart|payment') THEN 'sale' ELSE 'pre_sale' END AS level FROM documents""")
def cue_level(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", taxonomy.cue_level(F.col("text")).alias("level"))


@query(r"""WITH w AS (SELECT source AS cluster, unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z\p{L}\p{N}_]+', '  ', 'g'), '(?:^| )([a-z]{3,})(?: |$)', 1)) AS word FROM documents),
c AS (SELECT cluster, word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and') GROUP BY ALL)
SELECT cluster, string_agg(word, '_' ORDER BY n DESC, word) AS name FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) <= 4) GROUP BY cluster""")
def cluster_names(spark, d):
    docs = ad.table(spark, d, "documents").select(F.col("source").alias("cluster"), "text")
    return taxonomy.cluster_names(docs, ["the", "and"])


@query("SELECT CAST(conv_id * 100000 + turn AS VARCHAR) AS tweet_id, CASE WHEN turn > 0 THEN CAST(conv_id * 100000 + turn - 1 AS VARCHAR) END AS in_response_to_tweet_id, md5(text) AS digest FROM conversations WHERE text IS NOT NULL AND text <> ''")
def csv_replies(spark, d):
    """Replies written as CSV and read by the reader, columns found by their names."""
    r = ad.replies(spark, d).where("text IS NOT NULL AND text <> ''")
    at = shared_folder(spark)
    r.select("text", F.col("id").cast("string").alias("tweet_id"), F.col("parent").cast("string").alias("in_response_to_tweet_id")).write.option("header", True).option("escape", '"').csv(at)
    return files.read_replies(spark, at).select("tweet_id", "in_response_to_tweet_id", F.md5("text").alias("digest"))


@query("SELECT n_nationkey, n_name FROM nation")
def parquet_sink(spark, d):
    at = shared_folder(spark)
    files.write_parquet(ad.table(spark, d, "nation").select("n_nationkey", "n_name"), at)
    return files.read_parquet(spark, at)


@query("""SELECT r_name || '__' || n_name AS l5_id, r_name || '/nation/any/' || n_name || '/' || r_name || '__' || n_name AS path, count(c_custkey) || ' customers in ' || n_name AS definition
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name""")
def taxonomy_json(spark, d):
    """A pack with a leaf for each nation, written as JSON and read back; packs are made and read by the driver."""
    n, r, c = (ad.table(spark, d, t) for t in ("nation", "region", "customer"))
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("n"))
    nodes = {}
    for x in rows.orderBy("r_name", "n_name").limit(taxonomy.MAX_LEAVES).collect():
        leaf = f"{x['r_name']}__{x['n_name']}"
        nodes[leaf] = {"l5_id": leaf, "path": [x["r_name"], "nation", "any", x["n_name"], leaf], "definition": f"{x['n']} customers in {x['n_name']}"}
    with tempfile.TemporaryDirectory() as at:  # read back at once, by the driver alone
        files.write_taxonomy(taxonomy.Pack("1", nodes).to_dict(), f"{at}/pack.json")
        pack = taxonomy.Pack.from_dict(files.read_taxonomy(f"{at}/pack.json"))
    return pack.frame(spark).select("l5_id", F.array_join("path", "/").alias("path"), "definition")


@query(f"{own._PE} SELECT l5_id, dimension, value, dimension || '=' || value || ' over-indexes for ' || l5_id || ' (lift ' || round(lift, 2) || 'x, n=' || support || ')' AS claim FROM edges WHERE significant")
def claim_strings(spark, d):
    e = own.planted_edges(spark, d).where("significant")
    return e.select("l5_id", "dimension", "value", dr.claim(F.col("dimension"), F.col("value"), F.col("l5_id"), F.round("lift", 2), F.col("support")).alias("claim"))
