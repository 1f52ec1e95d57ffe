"""An inverted-file index of vectors: cells as Parquet partitions, residual codes, and filtered scans.

Cells are k-means clusters. A row is stored in the folder of its cell with its residual to
the centroid in one byte a component, its vector, and the columns that filters may name. A
query visits its nearest cells first. Scans read the codes of those cells and the rows that
pass the filter; only the best of them are scored again on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import similarity
from ..sources.lineage import cut_lineage

#: What a filtered search may do when a round of cells gave too few rows.
OFF, RELAXED, STRICT = "off", "relaxed", "strict"
#: Rows that cells are trained on, for each cell; the best codes scored again, for each row wanted.
SAMPLE_PER_CELL, OVERSAMPLE = 256, 4


@dataclass(frozen=True)
class VectorIndex:
    """A built index. ``centroids``: cells x components, of a size that the caller chose."""

    spark: SparkSession
    folder: str
    metric: str
    item_id: str
    centroids: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")


def _points(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _nearness(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Queries x points, higher is nearer; for unit vectors the inner product is the cosine."""
    inner = queries @ points.T
    return 2 * inner - (points * points).sum(axis=1) if metric == "l2" else inner


def build(items: DataFrame, folder: str, cells: int, metric: str = "cosine", item_id: str = "item_id", vector: str = "vector", columns: tuple[str, ...] = (), seed: int = 7) -> VectorIndex:
    """Writes the index of ``items`` to ``folder`` (shared by all executors).

    Centroids come from k-means over about ``SAMPLE_PER_CELL * cells`` rows, drawn by a hash
    of their ids; every row is stored. Rows whose vector is null, empty, of another length
    than the most, or holds nulls are not: they are similar to nothing. ``columns`` are kept
    for filters. A cell is dealt over several files by the size of its rows.
    """
    if metric not in ("cosine", "l2", "inner_product"):
        raise ValueError(f"unknown metric {metric}")
    spark = items.sparkSession
    usable = items.select(F.col(item_id), *columns, F.col(vector).cast("array<float>").alias("_vector")).filter(F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("_vector") > 0))
    sizes = usable.groupBy(F.size("_vector").alias("n")).count().orderBy(F.col("count").desc(), "n").head()
    if sizes is None:
        raise ValueError("no vectors to build an index of")
    dims, total = sizes["n"], sizes["count"]
    usable = usable.filter(F.size("_vector") == dims)
    wanted = SAMPLE_PER_CELL * cells
    drawn = usable.filter(F.pmod(F.xxhash64(F.col(item_id), F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, wanted / total) * (1 << 20)) + 1)
    length = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda acc, x: acc + x * x))
    point = F.transform("_vector", lambda x: F.when(length > 0, x / length).otherwise(0.0)) if metric == "cosine" else F.transform("_vector", lambda x: x.cast("double"))
    model = KMeans(k=cells, seed=seed, maxIter=8, initMode="random", featuresCol="point").fit(drawn.select(array_to_vector(point).alias("point")))
    centroids = np.array(model.clusterCenters())
    sent = spark.sparkContext.broadcast(centroids)
    names, at = [item_id, *columns, "vector", "code", "scale", "cell"], len(columns) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b.column(at), dims)
            x = _unit(x) if metric == "cosine" else x
            cell = _nearness(x, sent.value, "l2").argmax(axis=1)
            rest = x - sent.value[cell]
            scale = np.abs(rest).max(axis=1) / 127
            code = np.round(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(cell, pa.int32())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.schema if f.name != "_vector")
    coded = usable.mapInArrow(encode, f"{fields}, vector array<float>, code binary, scale double, cell int")
    coded.repartition("cell", F.pmod(F.xxhash64(item_id), F.lit(max(1, -(-total // (cells * 500_000)))))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/cells")
    spark.createDataFrame([(metric, item_id)], "metric string, item_id string").coalesce(1).write.parquet(f"{folder}/about")
    return VectorIndex(spark, folder, metric, item_id, centroids)


def load(spark: SparkSession, folder: str) -> VectorIndex:
    about = spark.read.parquet(f"{folder}/about").head()
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # as many as the builder chose
    return VectorIndex(spark, folder, about["metric"], about["item_id"], np.array([r["centroid"] for r in cells]))


def _scan(index: VectorIndex, queries: dict[int, np.ndarray], visits: dict[int, list[int]], where: Column | None, top: int) -> DataFrame:
    """The best ``top`` codes in each batch for each query: _q, id. Reads the visited cells alone."""
    dims, metric, centroids = index.centroids.shape[1], index.metric, index.centroids
    by_cell: dict[int, list[int]] = {}
    for q, cells in visits.items():
        for c in cells:
            by_cell.setdefault(c, []).append(q)
    sent = index.spark.sparkContext.broadcast((queries, by_cell, centroids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, visitors, centres = sent.value
        for b in batches:
            cell = b.column(3).to_numpy()
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int8).reshape(-1, dims)
            rows, mine, scores = [], [], []
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                points = centres[c] + code[at] * b.column(2).to_numpy()[at][:, None]
                qs = visitors[c]
                near = _nearness(np.stack([asked[q] for q in qs]), points, metric)
                keep = np.argpartition(-near, top - 1, axis=1)[:, :top] if len(at) > top else np.tile(np.arange(len(at)), (len(qs), 1))
                rows.append(at[keep].ravel())
                mine.append(np.repeat(qs, keep.shape[1]))
                scores.append(np.take_along_axis(near, keep, axis=1).ravel())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mine), pa.int32()), b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], names=["_q", "id", "about"])

    rows = index.rows().filter(F.col("cell").isin(*by_cell))
    rows = rows if where is None else rows.filter(where)
    kind = rows.schema[index.item_id].dataType.simpleString()
    found = rows.select(F.col(index.item_id).alias("id"), "code", "scale", "cell").mapInArrow(task, f"_q int, id {kind}, about double")
    best = Window.partitionBy("_q").orderBy(F.col("about").desc(), "id")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top).select("_q", "id")


def search(index: VectorIndex, queries: DataFrame, top: int, where: Column | None = None, mode: str = RELAXED, probes: int = 8, query_id: str = "query_id", vector: str = "vector", block: int = 4096) -> DataFrame:
    """The ``top`` nearest indexed rows of each query that pass ``where``: query_id, id, score, rank.

    A round visits ``probes`` more cells of each query, nearest first. With ``OFF`` there is
    one round, so a narrow filter may leave fewer than ``top`` rows. Otherwise queries that
    have fewer go on, twice as many cells each round, until they have ``top`` or all cells
    are visited. ``RELAXED`` lists what earlier rounds found first; ``STRICT`` ranks the rows
    of all rounds by score. Scores are the metric's similarity on the stored vectors, ties
    go to the lower id. With ``probes`` at the number of cells every row is compared.

    The queries, a stated set, are sent in blocks of ``block``. A query of another length
    than the index, or null, has no rows.
    """
    if mode not in (OFF, RELAXED, STRICT) or top < 1 or probes < 1:
        raise ValueError("mode is off, relaxed or strict; top and probes are at least 1")
    spark, kind = index.spark, queries.schema[query_id].dataType.simpleString()
    dims, cells = index.centroids.shape[1], len(index.centroids)
    asked = [(r[0], np.array(r[1], dtype=float)) for r in queries.select(query_id, vector).toLocalIterator() if r[1] is not None and len(r[1]) == dims and None not in r[1]]
    parts = []
    for start in range(0, len(asked), block):
        some = dict(enumerate(v for _, v in asked[start : start + block]))
        points = {q: _unit(v[None])[0] if index.metric == "cosine" else v for q, v in some.items()}
        order = {q: np.argsort(-_nearness(p[None], index.centroids, index.metric)[0], kind="stable").tolist() for q, p in points.items()}
        names = spark.createDataFrame([(q, asked[start + q][0], v.tolist()) for q, v in some.items()], f"_q int, `{query_id}` {kind}, _query array<double>")
        have, done, rounds, number, step = dict.fromkeys(some, 0), dict.fromkeys(some, 0), [], 0, probes
        while still := [q for q in some if have[q] < top and done[q] < cells and (number == 0 or mode != OFF)]:
            visits = {q: order[q][done[q] : done[q] + step] for q in still}
            found = cut_lineage(_scan(index, {q: points[q] for q in still}, visits, where, top * OVERSAMPLE))
            for q in still:
                done[q] += step
            for r in found.groupBy("_q").agg(F.count("*").alias("n")).collect():  # a row a query of the block
                have[r["_q"]] += r["n"]
            rounds.append(found.withColumn("_round", F.lit(number)))
            number, step = number + 1, 2 * step
        met = reduce(DataFrame.unionByName, rounds)
        stored = index.rows().filter(F.col("cell").isin(sorted({c for q in some for c in order[q][: done[q]]}))).select(F.col(index.item_id).alias("id"), F.col("vector").alias("_stored"))
        scored = met.join(stored, "id").join(F.broadcast(names), "_q").withColumn("score", F.round(similarity(F.col("_stored"), F.col("_query"), index.metric), 12))
        first = ["_round"] if mode == RELAXED else []
        rank = F.row_number().over(Window.partitionBy("_q").orderBy(*first, F.col("score").desc(), "id"))
        parts.append(scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(query_id, "id", "score", "rank"))
    if not parts:
        item = index.rows().schema[index.item_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{query_id}` {kind}, id {item}, score double, rank int")
    return reduce(DataFrame.unionByName, parts)
