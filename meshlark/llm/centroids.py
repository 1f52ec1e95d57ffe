"""Centroid clustering over integers, screened in single precision.

Vectors become integers once. An assignment first estimates all distances with a float32
matrix product and a bound on its rounding error; only centroids whose intervals overlap
that of the nearest estimate are compared again, with exact integers. Ties go to the
smaller number, so every run and every partitioning gives the same clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, written
from .vectors import finite, matrix, number_array, quantised

#: Half the distance between 1 and the next float32.
_UNIT = 2.0**-24


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance, both exact (int64 in and out).

    |p - c|^2 - |p|^2 = |c|^2 - 2 p.c is estimated with p.c in float32. Its error is at most
    g |p| |c| with g for n products, n - 1 sums and the rounding of both factors.
    """
    n = points.shape[1]
    as_float, own = points.astype(np.float32), np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    squares = (centroids.astype(np.float64) ** 2).sum(axis=1)
    about = squares - 2.0 * (as_float @ centroids.astype(np.float32).T).astype(np.float64)
    g = (n + 4) * _UNIT / (1 - (n + 4) * _UNIT)
    # The second term covers the double-precision sums, the squares' included.
    slack = 2.02 * g * own[:, None] * np.sqrt(squares) + (n + 4) * 2.0**-50 * (squares + own[:, None] ** 2)
    low, high = about - slack, (about + slack).min(axis=1)
    close = low <= high[:, None]
    cluster = close.argmax(axis=1)
    row, c = np.nonzero(close & (close.sum(axis=1) > 1)[:, None])
    off = points[row] - centroids[c]
    order = np.lexsort((c, (off * off).sum(axis=1), row))
    first = order[np.diff(row[order], prepend=-1) > 0]
    cluster[row[first]] = c[first]
    off = points - centroids[cluster]
    return cluster, (off * off).sum(axis=1)


def _seeds(points: DataFrame, k: int, salt: str, scale: int) -> np.ndarray:
    """The first ``k`` vectors by sha256 of "salt:id"; rows of one id in order of their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = points.filter("id IS NOT NULL").select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return quantised(np.array([r["vector"] for r in first], dtype=np.float64), scale) if first else np.zeros((0, 0), dtype=np.int64)


def _means(points: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The floors of the means of each cluster's vectors; empty clusters stay.

    Each task sends one row a cluster, so what meets does not grow with a cluster's size.
    """
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        total, count = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=np.int64)
        for b in batches:
            rows = quantised(matrix(b.column(0), dims), scale)
            cluster, _ = nearest(rows, centroids)
            for c in np.unique(cluster).tolist():
                total[c] += rows[cluster == c].sum(axis=0)
                count[c] += int((cluster == c).sum())
        full = np.flatnonzero(count).tolist()
        if full:
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full]), pa.array([[str(x) for x in total[c]] for c in full], pa.list_(pa.string()))], names=["cluster", "n", "total"])

    parts = points.select("vector").mapInArrow(sums, "cluster int, n long, total array<string>")
    by_place = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    found = by_place.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """Clusters of the vectors of ``dims`` components, and the final centroids (k x dims, int64).

    Vectors that are null, of another length, or hold null or non-finite components take no
    part. A component x counts as floor(scale * x), within +-2^26. Centroids start as the
    ``k`` vectors with the least sha256 of "salt:id" (all, if fewer; rows of a null id never
    start one, but are assigned), and move ``rounds`` times to the floor of the mean of their
    vectors; empty ones stay.

    Returns one row for each row that takes part, repeated ids and rows included:
    ``id_col``, ``cluster`` int, ``distance`` long (squared). Without any start vector, no
    rows. Other columns are not read. The driver sees the centroids alone.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    points = vectors.select(F.col(id_col).alias("id"), number_array(vectors, vector_col).alias("vector")).filter(finite(F.col("vector")) & (F.size("vector") == dims))
    centroids = _seeds(points, k, salt, scale)
    if not len(centroids):
        return points.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _means(points, centroids, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        for b in batches:
            cluster, distance = nearest(quantised(matrix(b.column(1), dims), scale), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return points.mapInArrow(assign, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with ``cluster_inertia`` and ``inertia`` (sums of distances) and ``centroid_sha256``.

    The digest is that of the centroid's components in decimal, joined by commas. Sums
    beyond 64 bits are given as the largest long. The one row a cluster goes to all tasks.
    """
    spark = assigned.sparkSession
    rows = written(assigned)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows at most
    inertia = sum(int(r["total"]) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    long = lambda x: min(int(x), 2**63 - 1)
    named = spark.createDataFrame([(r["cluster"], long(r["total"]), long(inertia), digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")
