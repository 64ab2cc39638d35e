"""The property graph: nodes, edges and runs, kept as a log of versions over bucketed Parquet segments.

A segment is a directory of three tables that is written once and never changed; nodes are bucketed by id, edges by (src, type,
dst). An update writes one segment of what is new, however large the graph is, and then the log entry of its version, which names the
base segment and the deltas after it. Reading merges: deltas among themselves, and the result with the base, whose buckets stay where
they are. ``compact`` writes the merged state as a new base.

The entry of version n is the file ``log/n.json``, made by a create that fails if the file is there. So of several writers that
worked on one version, one gets the next number; the others get ``Conflict`` and their segments are never named. A writer that
stops before its entry leaves nothing a reader sees. One that stops between creating its entry and closing it (a few bytes, after
all data) leaves an empty entry, which no reader counts; writers wait for it and then ask for ``repair``. Nothing is renamed, and
old versions stay readable: they are the snapshots.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import Tables
from ..functions.scores import cosine
from ..schemas import EDGE, NODE, RUN


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    runs: DataFrame
    #: The version that was read; None for a graph that is in no store.
    version: int | None = None


class Conflict(RuntimeError):
    """The version an update was made from is not the newest any more."""


def empty(spark: SparkSession, version: int | None = None) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODE, EDGE, RUN)), version)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id: new properties replace old ones whole; the old type, and an old embedding or version where the new is null, stay."""
    o = old.select("id", *(F.col(c).alias(f"o_{c}") for c in ("type", "props", "embedding", "pack_version", "updated_at")))
    n = new.select("id", *(F.col(c).alias(f"n_{c}") for c in ("type", "props", "embedding", "pack_version", "updated_at")), F.lit(True).alias("is_new"))
    d = o.join(n, "id", "full")
    pick = lambda c: F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    return d.select(
        "id", F.coalesce("o_type", "n_type").alias("type"), pick("props"), F.coalesce("n_embedding", "o_embedding").alias("embedding"),
        F.coalesce("n_pack_version", "o_pack_version").alias("pack_version"), pick("updated_at"),
    )


def edge_id() -> Column:
    return F.concat_ws(":", "src", "type", "dst")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (src, type, dst): new properties replace old ones whole."""
    d = old.select("src", "type", "dst", F.struct("props", "updated_at").alias("o")).join(new.select("src", "type", "dst", F.struct("props", "updated_at").alias("n")), ["src", "type", "dst"], "full")
    return d.select(edge_id().alias("id"), "src", "type", "dst", F.coalesce("n", "o")["props"].alias("props"), F.coalesce("n", "o")["updated_at"].alias("updated_at"))


def newest(rows: DataFrame, *key: str, order: str) -> DataFrame:
    """Of several rows of a key within one update, the last."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_p = 1").drop("_p")


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def query(nodes: DataFrame, node_type: str | None = None, filters: dict | None = None, order_by: str | None = None, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Nodes of a type whose properties equal the filters (an absent one equals None), by a numeric property (absent: 0) and id."""
    d = nodes if node_type is None else nodes.where(F.col("type") == node_type)
    for k, v in (filters or {}).items():
        want = F.lit(None).cast("string") if v is None else F.lit(str(v).lower() if isinstance(v, bool) else str(v))
        d = d.where(prop(k).eqNullSafe(want))
    if order_by:
        key = F.coalesce(prop(order_by).try_cast("double"), F.lit(0.0))
        d = d.orderBy(key.desc() if descending else key.asc(), "id")
    return d.limit(limit) if limit else d


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    """The node of that id: one row or none."""
    return nodes.where(F.col("id") == node)


def get_edges(edges: DataFrame, node: str, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    where = {"out": F.col("src") == node, "in": F.col("dst") == node, "both": (F.col("src") == node) | (F.col("dst") == node)}[direction]
    d = edges.where(where)
    return d if edge_type is None else d.where(F.col("type") == edge_type)


def traverse(edges: DataFrame, start: str | list[str], depth: int = 2, types: list[str] | None = None, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, distance; edges) of a breadth-first walk from one or several nodes: those at a distance below ``depth``, edges out of them.

    ``direction`` is out, in or both; both walks along source to target, as out does, but also reports edges into a node. The edges and each
    level are written to the shared folder and read back, so a level costs one join however deep the walk is; the walk ends with the first empty level.
    """
    spark = edges.sparkSession
    tables = Tables(spark, "walk")
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    ends = (F.col("dst").alias("at"), F.col("src").alias("to")) if direction == "in" else (F.col("src").alias("at"), F.col("dst").alias("to"))
    e = tables.cut(e) if depth > 2 else e  # edges may be costly to make: all levels and the edges found read one table
    step = e.select(*ends)
    seen = spark.createDataFrame([(x, 0) for x in ([start] if isinstance(start, str) else dict.fromkeys(start))], "id string, distance int")
    front = seen
    for d in range(1, depth):
        reached = step.join(front.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        front = tables.cut(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance")))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    ids = tables.cut(seen.select("id")) if depth > 2 else seen.select("id")  # of known size
    out = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    into = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = {"out": lambda: out, "in": lambda: into, "both": lambda: out.unionByName(into).dropDuplicates(["id"])}[direction]()
    return seen, found


def vector_search(nodes: DataFrame, query_vector: list[float], k: int = 5, node_type: str | None = None) -> DataFrame:
    """The k nodes nearest by cosine (ties by id); nodes without an embedding or of zero length are left out."""
    d = nodes if node_type is None else nodes.where(F.col("type") == node_type)
    q = F.lit([float(x) for x in query_vector])
    return d.where("embedding is not null").withColumn("score", cosine(F.col("embedding"), q)).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def vector_search_many(nodes: DataFrame, queries: DataFrame, k: int = 5, node_type: str | None = None, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query, id, score, place) of the k nodes nearest by cosine to each of ``queries`` (id string, embedding), through coarse cells.

    Vectors are brought to length one, where the nearest by distance are the nearest by cosine; those of length zero are left
    out. Without ``exact`` a query sees its ``probes`` nearest cells. ``operators.neighbours`` says how.
    """
    from ..operators import neighbours

    d = nodes if node_type is None else nodes.where(F.col("type") == node_type)

    def unit(rows: DataFrame) -> DataFrame:
        found = neighbours.usable(rows)
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return found.withColumn("length", length).where("length > 0").select("id", F.transform("vec", lambda x: (x.cast("double") / F.col("length")).cast("float")).alias("vec"))

    tables = Tables(nodes.sparkSession, "vectors")
    base = tables.cut(unit(d))
    found = neighbours.nearest(unit(queries), base, k, tables, probes, exact).select(F.col("id").alias("query"), F.posexplode("near").alias("place", "n"))
    # the score is that of the vectors as they are given
    vectors = lambda rows, c, v: neighbours.usable(rows).select(F.col("id").alias(c), F.col("vec").alias(v))
    found = found.select("query", F.col("n.near").alias("id"), (F.col("place") + 1).alias("place"))
    scored = found.join(vectors(d, "id", "own"), "id").join(vectors(queries, "query", "asked"), "query")
    return scored.select("query", "id", cosine(F.col("own"), F.col("asked")).alias("score"), "place")


def co_occurs(pairs: DataFrame, stamp: str) -> DataFrame:
    """Edges both ways for pairs (a, b) of leaves."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.distinct().select("src", F.lit("co_occurs").alias("type"), "dst", F.lit("{}").alias("props"), F.lit(stamp).alias("updated_at"))


KEYS = {"nodes": ["id"], "edges": ["src", "type", "dst"]}
SCHEMAS = {"nodes": NODE, "edges": EDGE, "runs": RUN}


def merged_deltas(name: str, deltas: list[DataFrame], buckets: int) -> DataFrame:
    """Updates of one table, oldest first, as one: what applying them one after another would leave of them. They are dealt out as the base is."""
    d = deltas[0].withColumn("_n", F.lit(0))
    for i, x in enumerate(deltas[1:], 1):
        d = d.unionByName(x.withColumn("_n", F.lit(i)))
    d = d.repartition(buckets, *KEYS.get(name, ["run_id"]))
    if name == "nodes":
        kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
        last = F.max_by(F.struct("props", "updated_at"), "_n").alias("x")
        return d.groupBy("id").agg(F.min_by("type", "_n").alias("type"), last, kept("embedding"), kept("pack_version")).select("id", "type", "x.props", "embedding", "pack_version", "x.updated_at")
    key = KEYS.get(name, ["run_id"])
    rest = [c for c in SCHEMAS[name].names if c not in key]
    return d.groupBy(*key).agg(F.max_by(F.struct(*rest), "_n").alias("x")).select(*(c if c in key else F.col("x")[c].alias(c) for c in SCHEMAS[name].names))


class Store:
    """The versions of a graph below one path, on any file system that Spark reaches.

    ``buckets`` counts for segments written from now on by ``compact`` and by the first update; later updates use those of the base.
    After ``compact_after`` updates a commit compacts. The session is told not to take a union of bucketed tables for bucketed itself:
    Spark 4.1.2 then leaves out the exchange below an aggregate and returns keys twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8, compact_after: int = 8, patience: float = 30.0):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.compact_after, self.patience = buckets, compact_after, patience
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> dict[int, int]:
        """The bytes of each log entry by its number."""
        p, fs = self._fs("log")
        found = fs.listStatus(p) if fs.exists(p) else []
        return {int(n[:-5]): x.getLen() for x in found if (n := x.getPath().getName()).endswith(".json") and n[:-5].isdigit()}

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((n for n, size in self._entries().items() if size), default=0)

    def entry(self, version: int) -> dict:
        if not version:
            return {"base": None, "deltas": [], "buckets": self.buckets}
        p, fs = self._fs(f"log/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _append(self, version: int, entry: dict) -> None:
        """Makes the entry of that version, or raises Conflict if there is one."""
        p, fs = self._fs(f"log/{version}.json")
        until = time.monotonic() + self.patience
        while True:
            try:
                out = fs.create(p, False)
            except Exception:
                if not fs.exists(p):
                    raise
                if fs.getFileStatus(p).getLen():
                    raise Conflict(f"version {version} has been written by someone else") from None
                if time.monotonic() >= until:
                    raise RuntimeError(f"{p.toString()} is empty: its writer stopped, or is about to fill it; see Store.repair") from None
                time.sleep(0.2)
                continue
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            return

    def repair(self) -> None:
        """Deletes empty log entries. Call it when no writer is at work."""
        for n, size in self._entries().items():
            if not size:
                p, fs = self._fs(f"log/{n}.json")
                fs.delete(p, False)

    def get(self, name: str, schema, buckets: int, keys: list[str]) -> DataFrame:
        """A table that ``put`` wrote, known to be bucketed."""
        known = f"graph_{uuid.uuid4().hex}"
        columns, by = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), ", ".join(keys)
        self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        d = self.spark.table(known)  # the plan holds what the catalog knew
        self.spark.sql(f"DROP TABLE {known}")
        return d

    def put(self, d: DataFrame, name: str, buckets: int, keys: list[str], overwrite: bool = False) -> None:
        """Writes a table bucketed and sorted by ``keys`` below the store's path."""
        known = f"graph_{uuid.uuid4().hex}"
        out = d.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        out.mode("overwrite" if overwrite else "error").option("path", f"{self.path}/{name}").saveAsTable(known)
        self.spark.sql(f"DROP TABLE {known}")  # an external table: its files stay

    def _table(self, segment: str, name: str, buckets: int) -> DataFrame:
        path = f"data/{segment}/{name}"
        if name not in KEYS:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{path}")
        return self.get(path, SCHEMAS[name], buckets, KEYS[name])

    def _segment(self, g: Graph, buckets: int) -> str:
        segment = uuid.uuid4().hex
        for name, keys in KEYS.items():
            self.put(getattr(g, name).select(*SCHEMAS[name].names), f"data/{segment}/{name}", buckets, keys)
        g.runs.write.parquet(f"{self.path}/data/{segment}/runs")
        return segment

    def read(self, version: int | None = None) -> Graph:
        v = self.version() if version is None else version
        if not v:
            return empty(self.spark, 0)
        e, found = self.entry(v), {}
        for name in SCHEMAS:
            of = lambda s, name=name: self._table(s, name, e["buckets"])
            deltas = [of(s) for s in e["deltas"]]
            new = deltas[0] if len(deltas) == 1 else merged_deltas(name, deltas, e["buckets"]) if deltas else None
            if e["base"] is None:
                found[name] = new
            elif new is None:
                found[name] = of(e["base"])
            else:
                upsert = {"nodes": upsert_nodes, "edges": upsert_edges}.get(name, lambda old, new: merged_deltas("runs", [old, new], 1))
                found[name] = upsert(of(e["base"]), new)
        return Graph(**found, version=v)

    def commit(self, update: Graph, base: int) -> int:
        """Adds an update (new and changed nodes, edges and runs, each key once) that was made from version ``base``; the new version.

        Raises Conflict if another version has come after ``base``; the update has then to be made again from the newest.
        """
        if self.version() != base:
            raise Conflict(f"made from version {base}, the newest is {self.version()}")
        e = self.entry(base)
        segment = self._segment(update, e["buckets"])
        self._append(base + 1, {"base": e["base"], "deltas": [*e["deltas"], segment], "buckets": e["buckets"]})
        if len(e["deltas"]) + 1 >= self.compact_after:
            return self.compact(base + 1)
        return base + 1

    def update(self, make: Callable[[Graph], Graph], tries: int = 5) -> int:
        """Commits ``make(newest graph)``; if someone else was faster, makes it again from what is newest then."""
        for _ in range(tries - 1):
            g = self.read()
            try:
                return self.commit(make(g), g.version)
            except Conflict:
                continue
        g = self.read()
        return self.commit(make(g), g.version)

    def write(self, g: Graph, base: int | None = None) -> int:
        """Puts ``g`` in place of the version that it was read from (or of ``base``); Conflict as for ``commit``."""
        base = g.version if base is None else base
        if base is None or self.version() != base:
            raise Conflict(f"made from version {base}, the newest is {self.version()}")
        segment = self._segment(g, self.buckets)
        self._append(base + 1, {"base": segment, "deltas": [], "buckets": self.buckets})
        return base + 1

    def compact(self, version: int | None = None) -> int:
        """The newest version as one base segment, in a version of its own. If someone else adds a version meanwhile, theirs stays."""
        g = self.read(version)
        try:
            return self.write(g)
        except Conflict:
            return g.version

    def snapshot(self, run_id: str) -> str:
        """The current version as JSON lines, one directory a table."""
        g, out = self.read(), f"{self.path}/snapshots/{run_id}"
        for name in ("nodes", "edges", "runs"):
            getattr(g, name).write.mode("overwrite").json(f"{out}/{name}")
        return out
