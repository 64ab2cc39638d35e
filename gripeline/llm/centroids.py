"""Operator 12: clustering vectors round centroids, exact in whole numbers, screened in single precision.

Each component x becomes the integer floor(scale * x). The first centroids are the k vectors whose ids have the smallest hashes.
A round assigns each vector to the nearest centroid by squared distance (ties: the smaller number) and moves each centroid that
has vectors to the floor of their mean; one without stays. After the rounds vectors are assigned once more.

A batch of vectors is compared with all centroids by one product of float32 matrices. The distance less the vector's own square
is then known to lie in an interval: the product errs by no more than gamma(d + 2) * |x| * |c| with gamma(n) = n u / (1 - n u) and
u = 2**-24, in whatever order the terms are added up, and the rounding of the rest is added to that. A centroid whose interval
lies above the upper end of another is out. What is left is computed again in 64-bit integers, which decide.

A round reads the input once. A task adds up its own vectors by centroid before anything is shuffled, so a shuffle has k rows
of sums a task however the vectors are spread, and the driver gets k centroids of d components, whatever the input's size.

Vectors of another length, and those with a null or non-finite component, are left out of the result. One with a component
beyond 2**27 in size has no exact distance in 64 bits: it is returned with null cluster and distance and moves nothing. Null ids
hash last; equal hashes are told apart by the vectors. Repeated rows count as often as they stand. An empty table, or one of
which nothing is kept, gives an empty result; with fewer than k vectors there are as many centroids. Other columns are ignored. Sums over a cluster that pass 64 bits are null.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cuts, small_batches

LARGEST = 1 << 27
#: Pairs of a vector and a centroid that are computed exactly at a time.
PAIRS = 1 << 15


def integers(batch: pa.RecordBatch, size: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept rows of a batch (second column: vectors), which of them are in range, and the integer vectors of those."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy()
    fits = np.flatnonzero((np.diff(ends) == size) & lists.is_valid().to_numpy(zero_copy_only=False))
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    x = flat[ends[fits][:, None] + np.arange(size)]
    finite = np.isfinite(x).all(1)
    fits = fits[finite]
    with np.errstate(over="ignore"):
        x = np.floor(scale * x[finite])
    inside = (np.abs(x) < LARGEST).all(1)
    return fits, inside, x[inside].astype(np.int64)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |x - c|^2 - |x|^2 for each vector and centroid."""
    unit, n = 2.0**-24, x.shape[1] + 2
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c.astype(np.float64) ** 2).sum(1)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(square)
    error = 2 * (n * unit / (1 - n * unit)) * norms * (1 + 2.0**-30) + 2.0**-45 * (square + 2 * np.abs(product))
    return square - 2 * product - error, square - 2 * product + error


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid, the exact squared distance, and how many pairs had to be computed exactly."""
    low, high = intervals(x, c)
    row, col = np.nonzero(low <= high.min(1)[:, None])
    exact = np.empty(len(row), np.int64)
    for k in range(0, len(row), PAIRS):
        part = slice(k, k + PAIRS)
        exact[part] = ((x[row[part]] - c[col[part]]) ** 2).sum(1)
    least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(x)))) if len(x) else exact
    hit = np.flatnonzero(exact == least[row])  # ascending by vector and then by centroid
    first = hit[np.unique(row[hit], return_index=True)[1]]
    return col[first], least, len(row)


def first_centroids(d: DataFrame, k: int, size: int, scale: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed:id``: k a batch, and k of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, inside, x = integers(b, size, scale)
            ids = b.column(0).take(pa.array(rows[inside])).to_pylist()
            hashes = ("~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids)
            least = heapq.nsmallest(k, zip(hashes, x.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in least], pa.string()), pa.array([v for _, v in least], pa.list_(pa.int64()))], names=["h", "x"])

    found = d.mapInArrow(run, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, size)


def moved(d: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)  # the last column counts
        for b in batches:
            x = integers(b, size, scale)[2]
            own = nearest(x, centroids)[0]
            order = np.argsort(own, kind="stable")
            there, start = np.unique(own[order], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(np.c_[x, np.ones(len(x), np.int64)][order], start, axis=0)
        there = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = d.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
    total = {(r["cluster"], r["i"]): int(r["s"]) for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return np.array([[total[j, i] // total[j, size] for i in range(size)] if (j, size) in total else centroids[j].tolist() for j in range(k)], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(id_col, cluster int, distance long, cluster_inertia long, inertia long, centroid array of long) for each vector kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    centroids = first_centroids(d, k, size, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(d, centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, inside, x = integers(b, size, scale)
            own, distance = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
            if len(x):
                own[inside], distance[inside], _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(own, mask=~inside), pa.array(distance, mask=~inside)], names=["id", "cluster", "distance"])

    done = Cuts(spark, "centroids").cut(d.mapInArrow(run, "id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in done.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(j, fits(n), fits(sum(sums.values())), centroids[j].tolist()) for j, n in sorted(sums.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    found = done.join(F.broadcast(about), "cluster", "left")  # k rows
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
