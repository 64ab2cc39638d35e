"""Density clusters with noise, by hierarchy (HDBSCAN), as joins: no point, edge or cluster is collected.

1. Equal vectors are one vertex with a weight; its core distance is that to its ``min_samples``-th other point, copies counted.
2. Vertices are joined to their nearest neighbours (``neighbours.nearest``) and, so that the graph hangs together, to the middle vertex
   of their cell; these middles, one a cell, to each other by a spanning tree. An edge weighs the mutual reachability distance, the
   largest of its length and the two core distances. Edges are in one total order: weight, then ids.
3. Borůvka rounds: each part takes its lightest edge out, parts so joined become one. The edges taken make the minimum spanning forest.
4. The same rounds give the dendrogram. An edge taken in round i lies in a part of each later round; the first round whose part
   has a lightest edge heavier than it (or none) names the chain that it belongs to, and a chain's edges in order are a path of
   the dendrogram that ends at that lightest edge. So parents are the next in a range sort, or the chain's end.
5. Sizes below each edge, the condensed tree's clusters (heads: a side of a split of two sides of ``min_cluster_size`` or more), and
   the cluster that each point falls out of, come from pointer doubling; stabilities are sums by cluster, with 1 / distance as density.
6. The most stable clusters are chosen from the leaves up, chains of clusters with one undecided child in jumps; everything else is noise, -1.

With exact neighbours and enough of them this is the clustering by the full mutual reachability graph; with fewer, groups that are
far apart are joined by links that may be longer than the shortest there is. The root is no cluster. Distances
below ``CLOSEST`` count as that. Rounds: some log2 of the vertices for Borůvka, of the tree's depth for doubling, and of the
number of clusters for the choice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import Tables
from .neighbours import Cells, nearest, usable
from .ordered import places

CLOSEST = 1e-9
NOISE = -1


def links(base: DataFrame, cells: Cells, tables: Tables) -> DataFrame:
    """(d, a, b) from each vertex of (id, vec) to the middle one of its cell, the nearest to the pivot, and a spanning tree of these.

    The middles, ``neighbours.MAX_CELLS`` of them at most, are collected.
    """
    placed = tables.cut(cells.place(base).select("cell", "away", "id"))
    middle = placed.groupBy("cell").agg(F.min(F.struct("away", "id"))["id"].alias("mid"))
    middles = tables.cut(middle.join(base.select(F.col("id").alias("mid"), F.col("vec").alias("mid_vec")), "mid"))
    gap = F.sqrt(F.aggregate(F.zip_with("vec", "mid_vec", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    stars = base.join(placed.select("id", "cell"), "id").join(middles, "cell").where("id != mid").select(gap.alias("d"), F.least("id", "mid").alias("a"), F.greatest("id", "mid").alias("b"))
    rows = middles.select("mid", "mid_vec").orderBy("mid").collect()
    x, found = np.array([r["mid_vec"] for r in rows], np.float64), []
    near, to = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)  # of those outside the tree: how far, and from which in it
    at, outside = 0, np.ones(len(rows), bool)
    for _ in range(len(rows) - 1):
        outside[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = outside & (d < near)
        near[closer], to[closer] = d[closer], at
        at = int(np.where(outside, near, np.inf).argmin())
        found.append((float(near[at]), *sorted((rows[at]["mid"], rows[int(to[at])]["mid"]))))
    return tables.cut(stars.unionByName(base.sparkSession.createDataFrame(found, "d double, a long, b long")))


def reachability(vertices: DataFrame, near: DataFrame, more: DataFrame, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, m, core) and edges (w, a, b) with a < b, from (id, m), (id, near) and further edges (d, a, b)."""
    lists = vertices.join(near, "id", "left").select("id", "m", F.explode_outer("near").alias("n")).select("id", "m", "n.d", "n.near")
    weights = vertices.select(F.col("id").alias("near"), F.col("m").alias("many"))
    lists = lists.join(weights, "near", "left")
    by = F.array_sort(F.collect_list(F.struct("d", "near", "many")))
    walk = F.aggregate("by", F.struct((F.col("m") - 1).alias("n"), F.when(F.col("m") > min_samples, F.lit(0.0)).alias("core")),
        lambda s, x: F.struct((s["n"] + x["many"]).alias("n"), F.coalesce(s["core"], F.when(s["n"] + x["many"] >= min_samples, x["d"])).alias("core")))
    found = lists.groupBy("id", "m").agg(F.filter(by, lambda x: x["near"].isNotNull()).alias("by")).withColumn("core", walk["core"])
    cores = found.select("id", "m", F.coalesce("core", F.element_at(F.transform("by", lambda x: x["d"]), F.when(F.size("by") > 0, F.lit(-1)).otherwise(F.lit(None).cast("int"))), F.lit(0.0)).alias("core"))
    edges = lists.where("near is not null").select("d", F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).unionByName(more)
    edges = edges.groupBy("a", "b").agg(F.min("d").alias("d"))
    core = lambda c: cores.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    w = F.greatest("d", "core_a", "core_b", F.lit(CLOSEST))
    return cores, edges.join(core("a"), "a").join(core("b"), "b").select(w.alias("w"), "a", "b")


def jump(d: DataFrame, tables: Tables, node: str, to: str) -> DataFrame:
    """``d`` (node, to) with ``to`` followed to its end, which is a node that points to itself."""
    d = tables.cut(d)
    while True:
        ahead = d.select(F.col(node).alias(to), F.col(to).alias("_next"))
        new = tables.cut(d.join(ahead, to).select(node, F.col("_next").alias(to), (F.col("_next") != F.col(to)).alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        tables.drop(d)
        d = new
        if not moved:
            return d.select(node, to)


def chains(vertices: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """The spanning forest's edges and the vertices (b null) as (w, a, b, level, part, end): the chain of each, and the edge that it ends at."""
    end = F.struct("w", "a", "b")
    out = tables.cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "a", "b").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w", "a", "b")))
    waiting = vertices.select(F.col("core").alias("w"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("id").alias("part"))
    done, level = [], 0
    while True:
        light = tables.cut(out.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("m")).select(F.col("u").alias("part"), F.struct("m.w", "m.a", "m.b").alias("end"), F.col("m.v").alias("v")))
        seen = tables.cut(waiting.join(light.select("part", "end"), "part", "left"))
        here = F.col("end").isNull() | F.col("b").isNull() | (F.struct("w", "a", "b") < F.col("end"))
        done.append(seen.where(here).select("w", "a", "b", F.lit(level).alias("level"), "part", "end"))
        if not light.limit(1).count():
            break
        ahead = light.select(F.col("part").alias("v"), F.col("end").alias("back"))
        to = F.when((F.col("back") == F.col("end")) & (F.col("part") < F.col("v")), F.col("part")).otherwise(F.col("v"))
        up = jump(light.join(ahead, "v").select("part", to.alias("to")), tables, "part", "to")
        left = seen.where(~here).select("w", "a", "b", "part").unionByName(light.select("end.w", "end.a", "end.b", "part"))
        waiting = tables.cut(left.join(up, "part").groupBy("a", "b").agg(F.max("w").alias("w"), F.max("to").alias("part")).select("w", "a", "b", "part"))
        joined = out.join(up.select(F.col("part").alias("u"), F.col("to").alias("u2")), "u").join(up.select(F.col("part").alias("v"), F.col("to").alias("v2")), "v").where("u2 != v2")
        lighter = joined.groupBy(F.col("u2").alias("u"), F.col("v2").alias("v")).agg(F.min(end).alias("m")).select("u", "v", "m.w", "m.a", "m.b")
        new = tables.cut(lighter)
        tables.drop(out)
        out, level = new, level + 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return tables.cut(every)


def dendrogram(vertices: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame:
    """(at, w, id, m, parent): id and m of vertices are null and 0 for edges; parent is the place of the edge above, null at a root."""
    d = chains(vertices, edges, tables).join(vertices.select(F.col("id").alias("a"), "m"), "a", "left")
    d = tables.cut(places(d, tables, F.col("level"), F.col("part"), F.col("w"), F.col("a"), F.col("b").asc_nulls_first()))
    following = d.select((F.col("at") - 1).alias("at"), F.col("level").alias("level2"), F.col("part").alias("part2"), F.col("at").alias("next"))
    ends = d.where("b is not null").select(F.struct("w", "a", "b").alias("end"), F.col("at").alias("above"))
    in_chain = (F.col("level") == F.col("level2")) & (F.col("part") == F.col("part2"))
    d = d.join(following, "at", "left").withColumn("next", F.when(in_chain, F.col("next"))).join(ends, "end", "left")
    is_vertex = F.col("b").isNull()
    return tables.cut(d.select("at", F.greatest("w", F.lit(CLOSEST)).alias("w"), F.when(is_vertex, F.col("a")).alias("id"), F.when(is_vertex, F.col("m")).otherwise(F.lit(0)).cast("long").alias("m"), F.coalesce("next", "above").alias("parent")))


def sizes(tree: DataFrame, tables: Tables) -> DataFrame:
    """(at, size): points at or below each place, by doubling: after round i a place has what lies less than 2**i below it."""
    d = tables.cut(tree.select("at", F.col("m").alias("size"), F.col("parent").alias("up")))
    while d.where("up is not null").limit(1).count():
        below = d.where("up is not null").groupBy(F.col("up").alias("at")).agg(F.sum("size").alias("more"))
        ahead = d.select(F.col("at").alias("up"), F.col("up").alias("up2"))
        new = tables.cut(d.join(below, "at", "left").join(ahead, "up", "left").select("at", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("up2").alias("up")))
        tables.drop(d)
        d = new
    return d.select("at", "size")


def condensed(tree: DataFrame, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, above, stability, selectable) and the cluster that each vertex falls out of (id, cluster; null: none)."""
    d = tables.cut(tree.join(sizes(tree, tables), "at"))
    big = d.where(F.col("size") >= least)
    n_big = big.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n_big"))
    above = n_big.select(F.col("at").alias("parent"), F.col("n_big").alias("beside"))
    d = tables.cut(d.join(above, "parent", "left").withColumn("big", F.col("size") >= least))
    head = F.col("parent").isNull() | (F.col("beside") >= 2)
    heads = jump(d.where("big").select("at", F.when(head, F.col("at")).otherwise(F.col("parent")).alias("cluster")), tables, "at", "cluster")
    # a place too small for a cluster points to its parent; roots and large places point to themselves
    outs = jump(d.select("at", F.when(F.col("big") | F.col("parent").isNull(), F.col("at")).otherwise(F.col("parent")).alias("out")), tables, "at", "out")
    large = d.where("big").select(F.col("at").alias("out"), (1 / F.col("w")).alias("density")).join(heads.withColumnRenamed("at", "out"), "out")
    vertices = tables.cut(d.where("id is not null").select("at", "id", "m").join(outs, "at").join(large, "out", "left").select("id", "m", "cluster", "density"))
    top = d.where(F.col("big") & head).select(F.col("at").alias("cluster"), "size", "parent")
    over = d.select(F.col("at").alias("parent"), (1 / F.col("w")).alias("birth"))
    born = top.join(over, "parent", "left").join(heads.select(F.col("at").alias("parent"), F.col("cluster").alias("above")), "parent", "left")
    born = tables.cut(born.select("cluster", "size", F.coalesce("birth", F.lit(0.0)).alias("birth"), "above"))
    falls = vertices.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("m") * F.col("density")).alias("x"), F.sum("m").alias("n"))
    parts = born.where("above is not null").groupBy(F.col("above").alias("cluster")).agg(F.sum(F.col("size") * F.col("birth")).alias("y"), F.sum("size").alias("k"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    stability = z("x") + z("y") - (z("n") + z("k")) * F.col("birth")
    roots = born.where("above is null").limit(2).count()
    clusters = born.join(falls, "cluster", "left").join(parts, "cluster", "left")
    return tables.cut(clusters.select("cluster", "above", stability.alias("stability"), (F.col("above").isNotNull() | F.lit(roots > 1)).alias("selectable"))), vertices


def _after(low: Column, high: Column) -> Column:
    """The step that takes ``low`` and then ``high``. A step tells a cluster's value from that of an open one below it, ``to``: ``flat`` up
    to ``upto``, and the value plus ``plus`` beyond; since plus + upto >= flat, steps in a row are one such step."""
    over = low["flat"] <= high["upto"]  # where low is flat, high is flat too
    upto = F.when(over, F.greatest(low["upto"], high["upto"] - low["plus"])).otherwise(low["upto"])
    flat = F.when(over, high["flat"]).otherwise(high["plus"] + low["flat"])
    return F.struct(low["to"].alias("to"), upto.alias("upto"), flat.alias("flat"), (low["plus"] + high["plus"]).alias("plus"))


def chosen(clusters: DataFrame, tables: Tables) -> DataFrame:
    """(cluster, label): the chosen cluster that a cluster is or lies in, from the most stable choice; clusters in none are left out.

    In a round clusters with no open child get their values, and those with one open child take a step that jumps, twice as far each
    round, down the chain of such clusters: some log2 of the clusters in rounds, however deep their tree.
    """
    c, never = F.col, F.lit(float("-inf"))
    own = c("selectable") & (c("stability") >= c("below") * (1 - 1e-9))
    below = F.coalesce(F.sum("value"), F.lit(0.0)).alias("below")
    kids = lambda d: d.where("above is not null").groupBy(c("above").alias("cluster")).agg(F.count_if(c("value").isNull()).alias("waits"), below, F.min(F.when(c("value").isNull(), c("cluster"))).alias("child"))
    with_kids = lambda d: d.join(kids(d), "cluster", "left").fillna({"waits": 0, "below": 0.0})
    d = tables.cut(clusters.select("*", F.lit(None).cast("double").alias("value"), F.lit(None).cast("struct<to:bigint,upto:double,flat:double,plus:double>").alias("step")))
    while d.where("value is null").limit(1).count():
        first = F.struct(c("child").alias("to"), F.when(c("selectable"), c("stability") / (1 - 1e-9) - c("below")).otherwise(never).alias("upto"), F.when(c("selectable"), c("stability")).otherwise(never).alias("flat"), c("below").alias("plus"))
        value = F.coalesce("value", F.when(c("waits") == 0, F.when(own, c("stability")).otherwise(c("below"))))
        told = tables.cut(with_kids(d).select("cluster", "above", "stability", "selectable", value.alias("value"), F.when(value.isNull() & (c("waits") == 1), F.coalesce("step", first)).alias("step")))
        tables.drop(d)
        ahead = told.select(c("cluster").alias("to"), c("value").alias("value2"), c("step").alias("step2"))
        met = told.withColumn("to", c("step.to")).join(ahead, "to", "left")
        reached = F.when(c("value2") <= c("step.upto"), c("step.flat")).otherwise(c("step.plus") + c("value2"))
        d = tables.cut(met.select("cluster", "above", "stability", "selectable", F.coalesce("value", reached).alias("value"), F.when(c("step2").isNull(), c("step")).otherwise(_after(c("step2"), c("step"))).alias("step")))
        tables.drop(told)
    d = tables.cut(with_kids(d).select("cluster", F.when(own, c("cluster")).alias("label"), c("above").alias("up")))
    while d.where("up is not null").limit(1).count():  # the topmost chosen one on the way up
        ahead = d.select(c("cluster").alias("up"), c("label").alias("label2"), c("up").alias("up2"))
        new = tables.cut(d.join(ahead, "up", "left").select("cluster", F.coalesce("label2", "label").alias("label"), c("up2").alias("up")))
        tables.drop(d)
        d = new
    return d.where("label is not null").select("cluster", "label")


def clusters(points: DataFrame, id_col: str = "id", vector_col: str = "embedding", min_cluster_size: int = 5, min_samples: int | None = None, neighbours: int = 15, probes: int = 8, exact: bool = False) -> DataFrame:
    """(id, cluster) of each point with a usable vector: the smallest id in its cluster, or -1 for noise.

    Points without an id, and those with a null, empty or non-finite vector or one of another length than the first pivot's, are not returned.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    tables = Tables(points.sparkSession, "density")
    samples = min_cluster_size if min_samples is None else min_samples
    every = tables.cut(usable(points.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col))
    members = tables.cut(every.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    base = members.select(F.col("rep").alias("id"), "vec")
    cells = Cells(base)
    if not len(cells.pivots):
        return every.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    fits = F.size("vec") == cells.pivots.shape[1]
    near = tables.cut(nearest(base, base, max(neighbours, samples), tables, probes, exact, same=True, cells=cells))
    more = links(base.where(fits), cells, tables)
    cores, edges = reachability(members.where(fits).select(F.col("rep").alias("id"), "m"), near, more, samples)
    cores, edges = tables.cut(cores), tables.cut(edges)
    tree = dendrogram(cores, edges, tables)
    found, vertices = condensed(tree, min_cluster_size, tables)
    labels = vertices.join(chosen(found, tables), "cluster").select("id", "label")
    names = labels.groupBy("label").agg(F.min("id").alias("cluster"))
    named = labels.join(names, "label").select(F.col("id").alias("rep"), "cluster")
    out = every.where(fits).join(members.select("vec", "rep"), "vec").join(named, "rep", "left")
    return out.select("id", F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster"))
