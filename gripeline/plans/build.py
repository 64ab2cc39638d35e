"""The build: from Tables A and B to the next version of the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..contract import admit
from ..folders import Tables
from ..functions.scores import tier, trend, with_severity
from ..operators import drivers as dr
from ..operators import metrics as me
from ..operators import themes as th
from ..schemas import HISTORY, RUN
from ..sources.taxonomy import Pack, parents
from .graph import Graph, Store, edge_id, newest, prop

_HIST = "array<struct<period:string,support:bigint,share:double,lift:double>>"


def json_of(**cols: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in cols.items())), {"ignoreNullFields": "false"})


def _node(kind: str, d: DataFrame, node_id: Column, props: Column, stamp: str, version: str | None = None) -> DataFrame:
    return d.select(
        node_id.alias("id"), F.lit(kind).alias("type"), props.alias("props"), F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(version).cast("string").alias("pack_version"), F.lit(stamp).alias("updated_at"),
    )


def _edge(kind: str, d: DataFrame, src: Column, dst: Column, stamp: str, props: Column | None = None) -> DataFrame:
    return d.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), (F.lit("{}") if props is None else props).alias("props"), F.lit(stamp).alias("updated_at"))


@dataclass
class Result:
    summary: dict
    version: int


def history_before(g: Graph) -> DataFrame:
    """(l5_id, dimension, value, history) of the affects edges there are."""
    parsed = F.from_json("props", T.StructType([T.StructField("dimension", T.StringType()), T.StructField("value", T.StringType()), T.StructField("history", HISTORY)]))
    return g.edges.where("type = 'affects'").select(F.col("src").alias("l5_id"), parsed.alias("p")).select("l5_id", "p.dimension", "p.value", "p.history")


def run(
    a: DataFrame, b: DataFrame, store: Store, run_id: str, stamp: str, pack: Pack | None = None, dimensions: list[str] | None = None,
    order_value: str | None = None, cfg: Config = DEFAULT,
) -> Result:
    """Validates, computes and upserts; the summary is collected, a few rows.

    A and B are read once: written with the columns needed and counted meanwhile (``contract.admit``). Tables by leaf and the
    cells of the cube are written too, so that each later step is planned over small files of known size. So is all that nodes and
    edges are made of: the update is a union of what has been written, and its plan makes the driver join and broadcast nothing.
    """
    spark = a.sparkSession
    tables = Tables(spark, "build")
    a, b, dims, n_rows = admit(a, b, tables, dimensions, (order_value,) if order_value else ())
    a = with_severity(a, cfg)
    if cfg.value_source == "joined" and order_value and order_value not in a.columns:
        a = a.join(b.select("conversation_id", order_value).hint("merge"), "conversation_id", "left")
    hold = tables.cut
    before = store.read()
    weekly = hold(me.weekly_metrics(a, order_value))
    z = hold(me.zscores(weekly, cfg))
    stats = hold(me.window_stats(a, order_value))
    scores = hold(me.egregiousness(stats, z, cfg))
    period = weekly.agg(F.max("week")).first()[0] or ""
    edges = hold(dr.drivers(dr.merge(a, b, dims), dims, period, history_before(before), cfg))
    systemic = hold(dr.systemic(edges, cfg))
    themes = hold(th.subthemes(a, quote_chars=200))

    nodes, links = [], []
    taxonomy = pack.frame(spark) if pack else None
    leaves = stats.join(z, "l5_id").join(scores.select("l5_id", "egregiousness"), "l5_id")
    if pack:
        leaves = leaves.join(F.broadcast(taxonomy), "l5_id", "left").withColumn("path", F.coalesce("path", F.array("l5_id"))).withColumn("definition", F.coalesce("definition", F.lit("")))
    else:
        leaves = leaves.withColumn("path", F.array().cast("array<string>")).withColumn("definition", F.lit(""))
    leaves = hold(leaves)
    struct = F.struct(F.col("dimension"), F.col("value"), F.round("lift", 2).alias("lift"), F.round("share", 4).alias("share"), F.col("support"), F.col("p_value"))
    ranked = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct(F.col("place"), rows.alias("x")))), lambda x: x["x"])  # noqa: E731  a few rows a leaf
    top = hold(dr.top_drivers(edges))
    tops = top.groupBy("l5_id").agg(ranked(struct).alias("top_drivers"))
    facet = F.struct(F.col("value"), F.round("share", 3).alias("share"), F.round("lift", 2).alias("lift"), F.col("significant"))
    by_dim = dr.facets(edges).groupBy("l5_id", "dimension").agg(ranked(facet).alias("v"))
    by_leaf = by_dim.groupBy("l5_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "v")))).alias("facets"))
    theme = F.struct(F.col("label"), F.col("count"), F.round("share", 3).alias("share"), F.col("quote"), F.round("severity", 1).alias("severity"))
    said = themes.groupBy("l5_id").agg(ranked(theme).alias("subthemes"))
    old = before.nodes.where("type = 'pain_point'").select(F.col("id").alias("l5_id"), prop("importance").alias("importance_prev"), prop("total_volume").cast("long").alias("volume_prev"), prop("first_seen").alias("first_seen"))
    points = hold(leaves.join(tops, "l5_id", "left").join(by_leaf, "l5_id", "left").join(said, "l5_id", "left").join(old, "l5_id", "left"))
    c = F.col
    nodes.append(_node("pain_point", points, c("l5_id"), json_of(
        l5_id=c("l5_id"), path=c("path"), definition=c("definition"), total_volume=c("total_volume"), severity_avg=F.round("severity_avg", 3), latest_zscore=F.round("zscore", 3),
        latest_egregiousness=F.round("egregiousness", 4), top_drivers=F.coalesce("top_drivers", F.array()), importance=tier(c("egregiousness"), cfg), importance_prev=c("importance_prev"),
        trend=trend(c("zscore"), cfg), facets=c("facets"), subthemes=F.coalesce("subthemes", F.array()), volume_prev=c("volume_prev"), first_seen=c("first_seen"), last_seen=F.lit(period),
    ), stamp, pack.version if pack else None))

    week = hold(weekly.where(c("week") == period).join(z.select("l5_id", "zscore"), "l5_id").join(scores.select("l5_id", "egregiousness"), "l5_id"))
    at = F.concat_ws("@", "l5_id", "week")
    nodes.append(_node("period_metric", week, at, json_of(
        l5_id=c("l5_id"), week=c("week"), volume=c("volume"), severity_avg=F.round("severity_avg", 3), sentiment_avg=F.round("sentiment_avg", 3), zscore=F.round("zscore", 3),
        egregiousness=F.round("egregiousness", 4), order_value_impact=F.lit(0.0),
    ), stamp))
    links += [_edge("measured_in", week, c("l5_id"), at, stamp), _edge("spiked_in", week.where("zscore >= 2.0"), c("l5_id"), at, stamp)]

    dim = F.concat_ws(":", F.lit("dim"), "dimension", "value")
    plain = hold(edges.select("dimension", "value").distinct().join(systemic, ["dimension", "value"], "left"))
    small = F.when(c("n_significant").isNull(), json_of(dimension=c("dimension"), value=c("value"))).otherwise(json_of(
        dimension=c("dimension"), value=c("value"), n_significant_l5=c("n_significant"), affected_l5s=c("affected_l5s"), total_support=c("total_support"), mean_lift=F.round("mean_lift", 3),
        max_lift=F.round("max_lift", 3), is_bridge=c("is_bridge"), is_singleton=c("is_singleton"), systemic_score=F.round("systemic_score", 4),
    ))
    nodes.append(_node("dimension", plain, dim, small, stamp))
    links.append(_edge("affects", edges, c("l5_id"), dim, stamp, json_of(
        dimension=c("dimension"), value=c("value"), support=c("support"), share=F.round("share", 4), lift=F.round("lift", 4), p_value=c("p_value"), significant=c("significant"),
        excess=F.round("excess", 2), period=c("period"), history=c("history"),
    )))

    cited = top.where("place <= 3").withColumn("lift2", F.round("lift", 2)).withColumn("claim", dr.claim(c("dimension"), c("value"), c("l5_id"), F.round("lift", 2), c("support")))
    key = F.concat(F.lit("verification:"), F.substring(F.sha1(F.concat_ws("|", "l5_id", "claim")), 1, 12))
    verdict = (c("lift") > 1) & (c("support") >= cfg.min_support)
    nodes.append(_node("verification", cited, key, json_of(
        l5_id=c("l5_id"), claim=c("claim"), verdict=F.when(verdict, "verified").otherwise("unsupported"), run_id=F.lit(run_id),
        detail=F.struct("dimension", "value", c("lift2").alias("lift"), "support", "p_value"),
    ), stamp))
    links += [_edge("verifies", cited, key, c("l5_id"), stamp), _edge("cites", cited, key, dim, stamp)]

    ex = hold(th.exemplars(a, taxonomy.select("l5_id", "definition") if pack else None, cfg))
    exid = F.concat(F.lit("exemplar:"), "conversation_id")
    nodes.append(_node("exemplar", ex, exid, json_of(
        conversation_id=c("conversation_id"), l5_id=c("l5_id"), snippet=c("snippet"), severity=c("severity"), sentiment=c("sentiment"), week=F.lit(period), brand=F.lit(""),
    ), stamp))
    links.append(_edge("exemplified_by", ex, c("l5_id"), exid, stamp))

    if pack:
        up = hold(parents(leaves.select("l5_id", "path")))
        nodes.append(_node("pain_point", up.select("parent", "level", "path").distinct(), c("parent"), json_of(l5_id=c("parent"), path=c("path"), level=c("level")), stamp, pack.version))
        links.append(_edge("child_of", up, c("child"), c("parent"), stamp))

    new_nodes, new_links = nodes[0], links[0]
    for x in nodes[1:]:
        new_nodes = new_nodes.unionByName(x)
    for x in links[1:]:
        new_links = new_links.unionByName(x)
    runs = spark.createDataFrame([(run_id, period, n_rows, pack.version if pack else None, stamp)], RUN)
    update = Graph(newest(new_nodes, "id", order="props"), newest(new_links.withColumn("id", edge_id()), "src", "type", "dst", order="props"), runs)
    version = store.commit(update, before.version)
    cells = edges.agg(F.count("*").alias("n"), F.count_if("significant").alias("s")).first()
    bridges = systemic.where("is_bridge").orderBy(F.desc("systemic_score"), "dimension", "value").limit(5).collect()
    summary = {
        "run_id": run_id, "period": period, "n_transcripts": n_rows, "n_l5": stats.count(), "n_driver_edges": cells["n"], "n_significant_drivers": cells["s"],
        "n_bridges": systemic.where("is_bridge").count(), "n_verifications": cited.count(),
        "top_egregious": [r[0] for r in scores.orderBy(F.desc("egregiousness"), "l5_id").limit(5).select("l5_id").collect()],
        "top_bridges": [f"{r['dimension']}={r['value']}" for r in bridges], "version": version,
    }
    return Result(summary, version)
