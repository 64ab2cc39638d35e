"""Nearest neighbours of many vectors: coarse cells round pivots, probed by a join on the cell.

Pivots come from a bounded sample (``SAMPLE`` vectors by hash of the id, moved to the means of their cells a few times); every
vector then goes to the cell of its nearest pivot. A query goes to its ``probes`` nearest cells. Cells are cut into blocks of some
``BLOCK`` vectors, so that a crowded cell is many records and not one; a task compares a block of queries with a block of a
cell by one matrix product and keeps k of each query, and these are brought together by query.

``exact`` adds a second pass that makes the result whole: a query also visits each cell that, by the triangle inequality, can hold
a vector no farther than the k-th one found so far. Distances are computed from differences in double precision, ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import Tables

MAX_CELLS = 4096
SAMPLE = 20_000
BLOCK = 1024
ROUNDS = 3


def usable(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec): rows with an id (long or string) whose vector has no null or non-finite component; of equal ids the first vector."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
    return d.where("id is not null and size(vec) > 0").where(whole).groupBy("id").agg(F.min("vec").alias("vec"))


class Cells:
    """Pivots, fitted on a sample of (id, vec)."""

    def __init__(self, vectors: DataFrame, n_cells: int | None = None, seed: int = 42):
        n = vectors.count()
        k = min(n_cells or math.ceil(math.sqrt(n)), MAX_CELLS, n)
        some = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(max(SAMPLE, 4 * k)).toArrow().column(0).to_pylist()
        some = [x for x in some if len(x) == len(some[0])]
        k = min(k, len(some))
        x = np.array(some, np.float64).reshape(len(some), len(some[0]) if some else 0)
        self.pivots = x[:k].copy()
        for _ in range(ROUNDS if k else 0):
            own = squares(x, self.pivots).argmin(1)
            sums, n_own = np.zeros_like(self.pivots), np.bincount(own, minlength=k)
            np.add.at(sums, own, x)
            self.pivots[n_own > 0] = sums[n_own > 0] / n_own[n_own > 0, None]

    def place(self, vectors: DataFrame) -> DataFrame:
        """(cell, away, id, vec binary): each vector in the cell of its nearest pivot, ``away`` from it."""
        pivots, kind = self.pivots, id_type(vectors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("vec"), pivots.shape[1])
                own = squares(x, pivots).argmin(1)
                away = np.sqrt(((x - pivots[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(away), b.column("id"), packed(x)], names=["cell", "away", "id", "vec"])

        return vectors.select("id", "vec").mapInArrow(run, f"cell int, away double, id {kind}, vec binary")

    def visits(self, queries: DataFrame, probes: int, radius: dict[int, float] | None = None) -> DataFrame:
        """(cell, id, vec binary) for each cell that a query visits: its ``probes`` nearest; with ``radius``, the others that can hold
        a vector within ``reach`` of it."""
        pivots, kind = self.pivots, id_type(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("vec"), pivots.shape[1])
                d = squares(x, pivots)
                order = np.argsort(d, axis=1, kind="stable")
                wanted = np.zeros(d.shape, bool)
                np.put_along_axis(wanted, order[:, :probes], True, 1)
                if radius is not None:
                    far = np.array([radius.get(c, -np.inf) for c in range(len(pivots))])
                    reach = b.column("reach").to_numpy(zero_copy_only=False)[:, None]
                    near = np.sqrt(d) - far <= reach * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(d))  # a visit too many does no harm
                    wanted = near & ~wanted
                row, cell = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("id").take(pa.array(row)), packed(x).take(pa.array(row))], names=["cell", "id", "vec"])

        keep = ["id", "vec"] if radius is None else ["id", "vec", "reach"]
        return queries.select(*keep).mapInArrow(run, f"cell int, id {kind}, vec binary")


def id_type(d: DataFrame) -> str:
    return d.schema["id"].dataType.simpleString()


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of float arrays (or of their bytes) of one length as a matrix of doubles."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, size).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, to the accuracy of a matrix product."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


def _blocks(placed: DataFrame, prefix: str, n_blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    return placed.groupBy("cell", block.alias(f"{prefix}_block")).agg(F.collect_list(F.struct("id", "vec")).alias(prefix))


def _compare(k: int, same: bool, size: int, kind: pa.DataType):
    """The k nearest in a block of base vectors of each query of a block."""

    def of(rows) -> tuple[np.ndarray, np.ndarray]:
        flat = rows.values
        return flat.field("id").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(flat.field("vec").to_pylist()), np.float32).reshape(-1, size).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (qs, q), (ns, n) = of(b.column("queries")[i]), of(b.column("base")[i])
                rough = squares(q, n)
                if same:
                    rough[qs[:, None] == ns] = np.inf
                last = np.partition(rough, min(k, len(ns)) - 1, axis=1)[:, min(k, len(ns)) - 1]
                slack = 1e-9 * (1 + (q**2).sum(1) + (n**2).sum(1).max())
                row, col = np.nonzero((rough <= (last + slack)[:, None]) & np.isfinite(rough))
                d = np.sqrt(((q[row] - n[col]) ** 2).sum(1))
                place = np.unique(ns, return_inverse=True)[1]
                order = np.lexsort((place[col], d, row))
                row, col, d = row[order], col[order], d[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = nth < k
                yield pa.RecordBatch.from_arrays([pa.array(qs[row[keep]], kind), pa.array(d[keep]), pa.array(ns[col[keep]], kind)], names=["id", "d", "near"])

    return run


def _meet(visits: DataFrame, placed: DataFrame, k: int, same: bool, size: int, n_blocks: int) -> DataFrame:
    pairs = _blocks(visits, "queries", n_blocks).join(_blocks(placed, "base", n_blocks), "cell").select("queries", "base")
    name = id_type(visits)
    return pairs.mapInArrow(_compare(k, same, size, pa.string() if name == "string" else pa.int64()), f"id {name}, d double, near {name}")


def _first(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near"))), 1, k).alias("near"))


def nearest(queries: DataFrame, base: DataFrame, k: int, tables: Tables, probes: int = 8, exact: bool = False, same: bool = False, cells: Cells | None = None) -> DataFrame:
    """(id, near: array of (d, near)) of the k nearest ``base`` vectors of each query, nearest first; both as ``usable`` gives them.

    ``same``: queries are base vectors, none is its own neighbour. A query that finds nothing is not returned.
    """
    cells = cells or Cells(base)
    if not len(cells.pivots):
        return queries.select("id", F.array().cast(f"array<struct<d:double,near:{id_type(queries)}>>").alias("near")).limit(0)
    size = cells.pivots.shape[1]
    fits = lambda d: d.where(F.size("vec") == size)
    placed = tables.cut(cells.place(fits(base)))
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()  # a row a cell
    n_blocks = max(1, -(-max((r["n"] for r in about), default=1) // BLOCK))
    found = _first(_meet(cells.visits(fits(queries), probes), placed, k, same, size, n_blocks), k)
    if not exact:
        return found
    found = tables.cut(found)
    reach = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    q = fits(queries).join(found.select("id", reach.alias("reach")), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    more = _meet(cells.visits(q, probes, {r["cell"]: r["away"] for r in about}), placed, k, same, size, n_blocks)
    return _first(found.select("id", F.explode("near").alias("n")).select("id", "n.d", "n.near").unionByName(more), k)
