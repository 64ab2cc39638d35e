"""Reads in the shape that an agent's tools return: small dicts, bounded whatever the size of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import reads
from .graph import Graph

#: Rows at most: significant drivers, cells of most lift beside them, trends.
DRIVERS, CELLS, TRENDS = 10, 15, 5


def drivers(g: Graph, l5_id: str) -> dict:
    """Significant drivers of a leaf by lift, with the last three entries of their history, and the leaf's first cells."""
    d = reads.drivers_of(g, l5_id)
    n = d.agg(F.count("*").alias("cells"), F.count_if("significant").alias("significant")).first()
    rounded = d.select("dimension", "value", F.round("lift", 2).alias("lift"), "support", F.round("share", 4).alias("share"), F.round("p_value", 4).alias("p_value"), "significant", F.round("excess", 1).alias("excess"), "history")
    return {
        "l5_id": l5_id, "total_cells": n["cells"], "significant_drivers": n["significant"],
        "drivers": [r.asDict(recursive=True) for r in rounded.where("significant").limit(DRIVERS).collect()],
        "heatmap_top": [r.asDict() for r in rounded.select("dimension", "value", "support", "share").limit(CELLS).collect()],
    }


def memory(g: Graph, l5_id: str) -> dict:
    """What is known of a leaf: its latest period, insights, and its first driver trends."""
    m = reads.memory(g, l5_id)
    last = m["periods"].orderBy(F.desc("week")).first()
    return {
        "l5_id": l5_id, "period_count": m["periods"].count(), "latest_period": last.asDict() if last else {},
        "prior_insights": [r.asDict(recursive=True) for r in m["insights"].select("summary", "cause", "action", "status", "run_id").limit(CELLS).collect()],
        "driver_trends": [r.asDict(recursive=True) for r in m["trends"].select("dimension", "value", "lift", "history").limit(TRENDS).collect()],
    }


def curated(g: Graph) -> dict:
    """The curated leaves and how many there are of each tier."""
    rows = [r.asDict(recursive=True) for r in reads.curated_set(g).collect()]
    tiers: dict[str, int] = {}
    for r in rows:
        tiers[r["importance"] or "low"] = tiers.get(r["importance"] or "low", 0) + 1
    return {"count": len(rows), "by_tier": tiers, "curated": rows}
