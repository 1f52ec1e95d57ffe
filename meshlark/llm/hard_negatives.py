"""Hard negatives by a block matrix product in two dimensions.

Anchors and rows are dealt into panels, and vectors are cut into chunks of dimensions. The
chunks of an anchor panel and of a row panel meet by tile through a shuffle; their partial
tiles of integer scores are added up in 64 bits where they arise, some anchors at a time,
so no scores travel. Each tile keeps the best of every anchor (for positives) or of every
window of an anchor and a positive (for negatives), and these are merged. Only tiles
within a label are multiplied for positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, kept, look_up_spread, written
from .vectors import finite, int_products, matrix, number_array, quantised

#: Anchors and rows of a tile, and dimensions of a chunk.
ANCHORS, ROWS, CHUNK = 4096, 8192, 32
#: Anchors of a tile whose scores a task holds at a time: 16 MB.
STEP = 256
#: Row panels' components that are on their way at a time, as a multiple of the table's.
WAVE = 1
_TILE = ["grp", "h", "g"]
_META = ["id", "label", "wanted"]


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go when it ends: waves would add up on the disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _chunked(rows: DataFrame, chunk: int, scale: int, dims: int) -> DataFrame:
    """``rows`` (grp, ..., vector) with one row for each chunk: ``k`` and ``part``, int32 values as bytes."""
    at = rows.columns.index("vector")
    names = [c for c in rows.columns if c != "vector"]
    ways = max(1, -(-dims // chunk))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        for b in batches:
            values = quantised(matrix(b.column(at), dims), scale).astype(np.int32)  # within +-2^26
            for k in range(ways):
                part = np.ascontiguousarray(values[:, k * chunk : (k + 1) * chunk])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.full(b.num_rows, k, dtype=np.int32)), pa.array([r.tobytes() for r in part], pa.binary())], names=[*names, "k", "part"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    return rows.mapInArrow(task, f"{fields}, k int, part binary")


_FOUND = ["anchor_id", "positive_id", "positive_score", "other_id", "score"]


def _tiles(anchors: DataFrame, rows: DataFrame, pick) -> DataFrame:
    """What ``pick`` keeps of each anchor's scores in each tile.

    Both inputs: grp, h, g, k, id, label, part; anchors also ``wanted``. A task holds the
    chunks of one tile and the scores of ``STEP`` of its anchors.
    ``pick(id, label, wanted, ids, labels, scores)`` gives rows (positive_id, positive_score,
    other_id, score).
    """

    def tile(sides: tuple[dict, dict]) -> Iterator[pa.RecordBatch]:
        if not sides[0] or not sides[1]:
            return
        left, right = ([np.frombuffer(b"".join(parts), dtype=np.int32).reshape(len(parts), -1).astype(np.int64) for _, parts in side.values()] for side in sides)
        meta, (ids, labels) = sides[0][0][0], (np.array(x, dtype=np.int64) for x in list(zip(*sides[1][0][0], strict=True))[:2])
        for at in range(0, len(meta), STEP):
            scores = sum(int_products(a[at : at + STEP], b) for a, b in zip(left, right, strict=True))
            out = [(x[0], *row) for x, s in zip(meta[at : at + STEP], scores, strict=True) for row in pick(*x, ids, labels, s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        now, sides = None, ({}, {})
        for b in batches:
            for *key, k, side, doc, label, wanted, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    yield from tile(sides)
                    now, sides = key, ({}, {})
                meta, parts = sides[side].setdefault(k, ([], []))
                if k == 0:
                    meta.append((doc, label, wanted))
                parts.append(part)
        yield from tile(sides)

    cols = [*_TILE, "k", "side", *_META, "part"]
    both = anchors.withColumn("side", F.lit(0)).select(cols).unionByName(rows.withColumns({"side": F.lit(1), "wanted": F.lit(None).cast("array<long>")}).select(cols))
    # Equal order in all chunks of a tile: ids are distinct within a side.
    return both.repartition(*_TILE).sortWithinPartitions(*_TILE, "side", "k", "id").mapInArrow(run, ", ".join(f"{n} long" for n in _FOUND))


def _first(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first rows: higher scores first, then smaller ids."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:n]]


def _best(found: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _product(anchors: DataFrame, rows: DataFrame, grp: Column, panels: Column, row_panels: Column, span: tuple[int, int], dims: int, chunk: int, scale: int, pick) -> DataFrame:
    """What ``pick`` keeps of all tiles of anchors ``span`` (first and last panel) with all rows of their group.

    ``anchors``: id, label, vector, wanted; ``rows``: id, label, vector. ``panels`` and
    ``row_panels``: how many panels the anchors and the rows of a group have; a row falls
    into one by hash.
    """
    h, g = (F.pmod(F.xxhash64("id"), n).cast("int") for n in (panels, row_panels))
    left = anchors.withColumn("grp", grp).withColumn("h", h).filter(F.col("h").between(*span)).select("grp", "h", row_panels.cast("int").alias("to"), *_META, "vector")
    right = rows.withColumn("grp", grp).select("grp", g.alias("g"), F.least(F.lit(span[1]), panels - 1).cast("int").alias("to"), "id", "label", "vector")
    every = lambda first: F.explode(F.sequence(F.lit(first), F.col("to")))
    a = _chunked(left.withColumn("to", F.col("to") - 1), chunk, scale, dims).withColumn("g", every(0))
    b = _chunked(right.filter(F.col("to") >= span[0]), chunk, scale, dims).withColumn("h", every(span[0]))
    return _tiles(a, b, pick)


def _waves(panels: int, step: int, product, by: list[str], n: int) -> DataFrame:
    """The best ``n`` of all tiles, worked off ``step`` anchor panels at a time."""
    parts = [written(_best(product((at, at + step - 1)), by, n)) for at in range(0, max(1, panels), step)]
    return reduce(DataFrame.unionByName, parts)


def _positives(anchors: DataFrame, rows: DataFrame, total: int, dims: int, chunk: int, scale: int, step: int, n: int) -> DataFrame:
    """anchor_id and ``wanted``: its positives and their scores, [id, score, id, score, ...], best first."""

    def pick(doc, label, wanted, ids, labels, scores):
        other = np.flatnonzero(ids != doc)
        return [(None, None, int(ids[i]), int(scores[i])) for i in other[_first(ids[other], scores[other], n)].tolist()]

    asking = anchors.groupBy("label").agg(F.ceil(F.count("*") / ANCHORS).alias("hs"))
    labels = written(rows.groupBy("label").agg(F.count("*").alias("docs"), F.ceil(F.count("*") / ROWS).alias("gs")).join(asking, "label"))
    most = labels.agg(F.coalesce(F.max("hs"), F.lit(0))).head()[0]
    known = [look_up_spread(x, labels, ["label"], "docs", total) for x in (anchors, rows)]
    best = _waves(most, step, lambda span: _product(*known, F.col("label"), F.col("hs"), F.col("gs"), span, dims, chunk, scale, pick), ["anchor_id"], n)
    return best.groupBy("anchor_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))), lambda x: F.array(x["other_id"], x["score"]))).alias("wanted"))


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), scale: int = 256, chunk: int = CHUNK, wave: int = WAVE,
) -> DataFrame:
    """The hardest allowed negatives of each anchor and positive.

    ``anchors``: a condition on ids. A component x counts as floor(scale * x), within
    +-2^26; a score is the integer inner product, shorter vectors being filled with zeros.
    Rows with a null id or label, or a vector that is null or holds null or non-finite
    components, take no part. Of rows that share an id, the one with the least label, then
    vector, takes part; so repeated rows count once. Scores rank from high to low, equal
    ones by id.

    An anchor's positives are its first ``positives`` other rows of its label. Of the rows
    of other labels with ``window[0] * p <= 100 * score <= window[1] * p`` for a positive's
    score p, the first ``negatives`` are returned: ``anchor_id``, ``positive_id``, ``rank``
    int, ``negative_id``, ``positive_score``, ``negative_score``, longs. Anchors without
    positives, and positives without such rows, have none; an empty table gives no rows.
    Other columns are not read.

    Anchor panels are worked off in waves: a wave sends the rows' components to at most
    ``wave`` panels, so what is on its way is in proportion to the table, however many
    anchors there are.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    own = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), number_array(vectors, vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    one = own.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
    with _shuffles_dropped(vectors.sparkSession):
        rows = written(one.select("id", "row.label", "row.vector", "row.anchor"))
        total, asking, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(1))).head()
        dims = max(1, dims)  # empty vectors count as zeros
        asked, rows_ = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
        found = _positives(asked.withColumn("wanted", F.lit(None).cast("array<long>")), rows_, total, dims, chunk, scale, wave, positives)
        asked = written(asked.join(found.withColumnRenamed("anchor_id", "id").hint("merge"), "id"))
        low, high = window

        def pick(doc, label, wanted, ids, labels, scores):
            out, other = [], np.flatnonzero(labels != label)
            s, ids = 100 * scores[other], ids[other]
            for positive, p in zip(wanted[::2], wanted[1::2], strict=True):
                fit = np.flatnonzero((low * p <= s) & (s <= high * p))
                out += [(positive, p, int(ids[i]), int(s[i]) // 100) for i in fit[_first(ids[fit], s[fit], negatives)].tolist()]
            return out

        panels, row_panels = max(1, -(-asking // ANCHORS)), max(1, -(-total // ROWS))
        best = _waves(panels, wave, lambda span: _product(asked, rows_, F.lit(0).cast("long"), F.lit(panels), F.lit(row_panels), span, dims, chunk, scale, pick), ["anchor_id", "positive_id"], negatives)
        discard(rows, asked)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
