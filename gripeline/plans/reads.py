"""Reads of the graph: each returns a DataFrame (or, for one claim, a dict) from nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scores import movement
from ..functions.text import overlap
from .graph import Graph

_TOP = "array<struct<dimension:string,value:string,lift:double,share:double,support:bigint,p_value:double>>"
_THEME = "array<struct<label:string,count:bigint,share:double,quote:string,severity:double>>"
_FACET = "map<string,array<struct<value:string,share:double,lift:double,significant:boolean>>>"
_POINT = (
    f"l5_id string, path array<string>, definition string, total_volume bigint, severity_avg double, latest_zscore double, latest_egregiousness double, top_drivers {_TOP}, "
    f"importance string, importance_prev string, trend string, facets {_FACET}, subthemes {_THEME}, volume_prev bigint, first_seen string, last_seen string"
)
_HIST = "array<struct<period:string,support:bigint,share:double,lift:double>>"
_AFFECTS = f"dimension string, value string, support bigint, share double, lift double, p_value double, significant boolean, excess double, period string, history {_HIST}"
_EXEMPLAR = "conversation_id string, l5_id string, snippet string, severity double, sentiment string, week string"
_DIM = "dimension string, value string, n_significant_l5 int, affected_l5s array<string>, total_support bigint, mean_lift double, max_lift double, is_bridge boolean, is_singleton boolean, systemic_score double"


def _parsed(d: DataFrame, schema: str, *keep: str) -> DataFrame:
    return d.select(*keep, F.from_json("props", schema).alias("p")).select(*keep, "p.*")


def as_of(g: Graph, stamp: str | None = None) -> Graph:
    """The graph with the driver edges and dimension nodes that the run of that time wrote (default: the newest run), without those
    that only earlier runs found. All other nodes and edges accumulate and stay."""
    if stamp is None:
        newest = g.runs.agg(F.max(F.struct("created_at", "run_id"))["created_at"].alias("t")).first()
        stamp = newest["t"]
    now = F.col("updated_at") == stamp
    return Graph(g.nodes.where((F.col("type") != "dimension") | now), g.edges.where((F.col("type") != "affects") | now), g.runs, g.version)


def pain_points(g: Graph) -> DataFrame:
    return _parsed(g.nodes.where("type = 'pain_point'"), _POINT)


def leaves(g: Graph) -> DataFrame:
    """Pain points with a full path; parents of the roll-up are none."""
    return pain_points(g).where(F.size("path") >= 5)


def affects(g: Graph) -> DataFrame:
    return _parsed(g.edges.where("type = 'affects'"), _AFFECTS, "src").withColumnRenamed("src", "l5_id")


def top_leaves(g: Graph, by: str = "egregiousness", n: int = 10) -> DataFrame:
    key = {"zscore": "latest_zscore", "volume": "total_volume"}.get(by, "latest_egregiousness")
    return leaves(g).orderBy(F.coalesce(F.col(key).cast("double"), F.lit(0.0)).desc(), "l5_id").limit(n)


def spikes(g: Graph, threshold: float = DEFAULT.spike) -> DataFrame:
    return leaves(g).where(F.col("latest_zscore") >= threshold).orderBy(F.desc("latest_zscore"), "l5_id")


def drivers_of(g: Graph, l5_id: str, significant_only: bool = False, last: int = 3) -> DataFrame:
    d = affects(g).where(F.col("l5_id") == l5_id)
    d = d.where("significant") if significant_only else d
    n = F.size("history")
    return d.withColumn("history", F.slice("history", F.greatest(n - last, F.lit(0)) + 1, F.lit(last))).orderBy(F.desc("lift"), "dimension", "value")


def ops_hotspots(g: Graph, dimension: str | None = None, k: int = 5) -> DataFrame:
    """(dimension, value, leaves): by value the leaves of most support."""
    d = affects(g) if dimension is None else affects(g).where(F.col("dimension") == dimension)
    place = F.row_number().over(Window.partitionBy("dimension", "value").orderBy(F.desc("support"), "l5_id"))
    d = d.withColumn("place", place).where(F.col("place") <= k)
    return d.groupBy("dimension", "value").agg(F.array_sort(F.collect_list(F.struct("place", "l5_id", "support", "lift", "significant"))).alias("leaves"))


def exemplars_of(g: Graph, l5_id: str, k: int = 3) -> DataFrame:
    e = g.edges.where((F.col("src") == l5_id) & (F.col("type") == "exemplified_by")).select(F.col("dst").alias("id"))
    return _parsed(g.nodes.join(e, "id", "left_semi"), _EXEMPLAR).orderBy(F.desc("severity"), "conversation_id").limit(k)


def period_series(g: Graph, l5_id: str) -> DataFrame:
    e = g.edges.where((F.col("src") == l5_id) & (F.col("type") == "measured_in")).select(F.col("dst").alias("id"))
    schema = "week string, volume bigint, severity_avg double, sentiment_avg double, zscore double, egregiousness double"
    return _parsed(g.nodes.join(e, "id", "left_semi"), schema, "id").orderBy("id")


def insights_of(g: Graph, l5_id: str) -> DataFrame:
    e = g.edges.where((F.col("dst") == l5_id) & (F.col("type") == "explains")).select(F.col("src").alias("id"))
    return _parsed(g.nodes.join(e, "id", "left_semi"), "l5_id string, run_id string, summary string, cause string, action string, evidence array<string>, status string", "id").orderBy("id")


def memory(g: Graph, l5_id: str) -> dict:
    """What is known of a leaf: its node, period series, insights, and driver trends with a history."""
    return {
        "node": pain_points(g).where(F.col("l5_id") == l5_id), "periods": period_series(g, l5_id), "insights": insights_of(g, l5_id),
        "trends": affects(g).where((F.col("l5_id") == l5_id) & (F.size("history") > 0)).orderBy(F.desc("lift"), "dimension", "value"),
    }


def curated_set(g: Graph, cfg: Config = DEFAULT) -> DataFrame:
    d = leaves(g).orderBy(F.desc("latest_egregiousness"), "l5_id").limit(cfg.curated_cap)
    return d.select(
        "l5_id", "path", "importance", "importance_prev", movement(F.col("importance_prev"), F.col("importance"), cfg).alias("movement"), "trend",
        F.col("latest_egregiousness").alias("egregiousness"), F.col("latest_zscore").alias("zscore"), F.col("total_volume").alias("volume"),
        (F.col("total_volume") - F.col("volume_prev")).alias("volume_delta"), "severity_avg", "top_drivers", "facets", "subthemes", "last_seen",
    )


def leaf_profile(g: Graph, l5_id: str) -> DataFrame:
    """One row with found; the rest is null if there is no such leaf."""
    one = g.nodes.sparkSession.createDataFrame([(l5_id,)], "l5_id string")
    d = pain_points(g).select("l5_id", "path", "definition", "total_volume", "severity_avg", "importance", "facets", "subthemes", "top_drivers", F.lit(True).alias("found"))
    return one.join(d, "l5_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def systemic_drivers(g: Graph, only_bridges: bool = False, k: int = 10) -> DataFrame:
    d = _parsed(g.nodes.where("type = 'dimension'"), _DIM).where("n_significant_l5 > 0")
    d = d.where("is_bridge") if only_bridges else d
    return d.orderBy(F.desc("is_bridge"), F.desc("systemic_score"), "dimension", "value").limit(k)


def verify_claims(g: Graph, claims: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Claims (l5_id, dimension, value) with verdict, reason and the figures of their edges: one join for any number of claims.

    Verified is what the graph holds as significant, with a lift above one and support enough; a claim without an edge says so.
    """
    found = affects(g).select("l5_id", "dimension", "value", "lift", "support", "p_value", "significant", F.lit(True).alias("_edge"))
    ok = F.coalesce(F.col("significant") & (F.col("lift") > 1) & (F.col("support") >= cfg.min_support), F.lit(False))
    d = claims.join(found, ["l5_id", "dimension", "value"], "left")
    return d.select(
        *claims.columns, F.when(ok, "verified").otherwise("unsupported").alias("verdict"), F.when(F.col("_edge").isNull(), "no edge").alias("reason"),
        "lift", "support", "p_value", "significant",
    )


def verify_claim(g: Graph, l5_id: str, dimension: str, value: str, cfg: Config = DEFAULT) -> dict:
    one = g.edges.sparkSession.createDataFrame([(l5_id, dimension, value)], "l5_id string, dimension string, value string")
    r = verify_claims(g, one, cfg).first().asDict()
    return {k: v for k, v in r.items() if v is not None}


def search(g: Graph, query: str, l5_id: str | None = None, k: int = 5) -> DataFrame:
    """Exemplars that share words with the query, by share of its words and severity."""
    d = _parsed(g.nodes.where("type = 'exemplar'"), _EXEMPLAR)
    d = d if l5_id is None else d.where(F.col("l5_id") == l5_id)
    score: Column = overlap(F.col("snippet"), F.lit(query))
    return d.withColumn("match_score", F.round(score, 3)).where("match_score > 0").orderBy(F.desc("match_score"), F.desc("severity"), "conversation_id").limit(k)


def tier_counts(g: Graph, cfg: Config = DEFAULT) -> DataFrame:
    return curated_set(g, cfg).groupBy(F.coalesce("importance", F.lit("low")).alias("importance")).count()


def write_insight(g: Graph, l5_id: str, run_id: str, summary: str, cause: str, action: str, evidence: list[str], stamp: str) -> Graph:
    """The graph with an insight, an edge to its leaf and one to each piece of evidence."""
    from .graph import upsert_edges, upsert_nodes

    spark = g.nodes.sparkSession
    one = spark.createDataFrame([(l5_id, run_id, summary, cause, action, evidence, "new")], "l5_id string, run_id string, summary string, cause string, action string, evidence array<string>, status string")
    key = F.concat_ws(":", F.lit("insight"), F.lit(run_id), F.lit(l5_id), F.substring(F.sha1(F.concat_ws("|", "summary", "cause", "action")), 1, 8))
    node = one.select(key.alias("id"), F.lit("insight").alias("type"), F.to_json(F.struct("*")).alias("props"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("pack_version"), F.lit(stamp).alias("updated_at"))
    e = one.select(key.alias("src"), F.explode(F.concat(F.array(F.struct(F.lit("explains").alias("type"), F.col("l5_id").alias("dst"))), F.transform("evidence", lambda x: F.struct(F.lit("cites").alias("type"), x.alias("dst"))))).alias("x"))
    edges = e.select("src", "x.type", "x.dst", F.lit("{}").alias("props"), F.lit(stamp).alias("updated_at"))
    return Graph(upsert_nodes(g.nodes, node), upsert_edges(g.edges, edges), g.runs, g.version)


def list_runs(g: Graph) -> DataFrame:
    return g.runs.orderBy(F.desc("created_at"), "run_id")


