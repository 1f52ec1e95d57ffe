"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

1. Equal vectors form a class; a class has its least ids. Classes are what is indexed.
2. A vector x becomes (x / m, sqrt(1 - |x / m|^2)) with m the greatest norm, a query
   (q / |q|, 0), so that the largest inner product is the smallest angle.
3. Each tree has a string of ``BITS`` hyperplane bits for each class. The forest holds, for
   each tree, its classes in order of their strings, cut into parts of bounded size.
4. Descent: a query finds the place of its string in every tree. The classes next to it,
   which share the longest prefixes, give its first list of neighbours.
5. Ascent: a neighbour at cosine s shares a prefix of x bits in a tree with the chance p^x,
   p = 1 - acos(s) / pi. With the score of the last one found as s, the query goes up, in
   all trees at once, to the longest prefix at which the chance to miss such a neighbour in
   every tree, (1 - p^x)^trees, is at most ``miss``, and meets all classes with that prefix.
   No count of candidates ends the ascent; at no bits all classes are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_ranges, kept, look_up_spread, written
from .vectors import exact_scores, finite, matrix, number_array

#: Trees, bits of a string (5 bits above it hold the tree), and the chance to miss the last neighbour.
TREES, BITS, MISS = 16, 58, 0.1
#: Classes on each side of a query's place that the descent compares it with.
BESIDE = 128
#: Classes in a part; with more than ``PARTS`` of these, parts grow instead.
PART_ROWS, PARTS = 8192, 1 << 20
#: Queries that visit one part in one task, on average.
VISITS = 16384
#: Queries multiplied at a time.
_BLOCK = 128


def planes(dims: int, trees: int, seed: int) -> np.ndarray:
    """Normals of all hyperplanes: (dims + 1) x (trees * BITS)."""
    return np.random.default_rng(seed).standard_normal((dims + 1, trees * BITS))


def strings(points: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """The key of each point in each tree: the tree's number, then the bits, as one int64."""
    bits = (points @ normals > 0).reshape(len(points), trees, BITS).astype(np.int64)
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return (bits @ weights) + (np.arange(trees, dtype=np.int64) << np.int64(BITS))


def on_sphere(vectors: np.ndarray, top: float, longest: float, query: bool) -> np.ndarray:
    """Points of norm 1. ``top``: the greatest component of all; ``longest``: the greatest norm of vectors / top."""
    x = vectors / top
    norm = np.sqrt((x * x).sum(axis=1))
    if query:
        # A query's own scale is free: a tiny one must not vanish.
        own = np.abs(x).max(axis=1, initial=0, keepdims=True)
        x = np.divide(x, own, out=np.zeros_like(x), where=own > 0)
        norm = np.sqrt((x * x).sum(axis=1))
        return np.column_stack([x / np.maximum(norm, 1e-300)[:, None], np.zeros(len(x))])
    return np.column_stack([x / longest, np.sqrt(np.maximum(0.0, 1 - (norm / longest) ** 2))])


def levels(cosine: Column, trees: int, miss: float) -> Column:
    """The longest prefix at which a neighbour at ``cosine`` is missed by all trees with ``miss`` at most."""
    s = F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))
    p = F.lit(1.0) - F.acos(s) / F.pi()
    least = log(1 - miss ** (1 / trees))  # p^x has to be at least this, as a logarithm
    return F.when(p >= 1, F.lit(BITS)).when(p <= 0, F.lit(0)).otherwise(F.least(F.lit(BITS), F.floor(F.lit(least) / F.ln(p)))).cast("int")


def common_bits(a: int, b: int) -> int:
    """Length of the prefix that two keys share; below 0 for keys of two trees."""
    return min(BITS - (a ^ b).bit_length(), BITS)


def _listed(queries: np.ndarray, items: np.ndarray, least: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best items not below its floor: places of queries and items, and exact scores."""
    about = queries @ items.T
    bound = floors
    if len(items) > k:
        bound = np.maximum(floors, np.partition(about, len(items) - k, axis=1)[:, len(items) - k])
    size = np.abs(queries).max(initial=0) * np.abs(items).max(initial=0) * queries.shape[1]
    q, i = np.nonzero(about >= (bound - size * (queries.shape[1] + 2) * 2.0**-51)[:, None])
    score = exact_scores(queries[q], items[i])
    order = np.lexsort((least[i], -score, q))
    q, i, score = q[order], i[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = (rank < k) & (score >= floors[q])
    return q[keep], i[keep], score[keep]


_FOUND = "query long, class long, least long, score double, covered int"


def _visits(items: DataFrame, queries: DataFrame, k: int, beside: int, dims: int) -> DataFrame:
    """The best ``k`` classes that each query meets in each part that it visits.

    items: part, class, key, least, vector. queries: part, query, key, low, high (keys; both
    null in the descent), floor, vector. ``covered``: in the descent, the number of bits
    from which on a prefix of the query has no classes in this tree but those met.
    Parts are spread over several tasks if many queries visit them. A task holds one part.
    """

    def block(part: tuple, rows: list) -> Iterator[tuple]:
        keys, classes, least, vectors = part
        rows.sort(key=lambda r: (r[2] is None, r[2] or 0, r[3] or 0, r[1]))
        near = [r for r in rows if r[2] is None]
        for r in near:
            at = int(np.searchsorted(keys, r[1]))
            low, high = max(0, at - beside), min(len(keys), at + beside)
            covered = BITS + 1 if low == 0 or high == len(keys) else 1 + max(common_bits(int(keys[x]), r[1]) for x in (low - 1, high))
            yield [r], low, high, covered
        wide = rows[: len(rows) - len(near)]
        at = 0
        while at < len(wide):
            to = at
            while to < len(wide) and to - at < _BLOCK and wide[to][2:4] == wide[at][2:4]:
                to += 1
            low, high = (int(x) for x in np.searchsorted(keys, [wide[at][2], wide[at][3]]))
            yield wide[at:to], low, high, 0
            at = to

    def answers(part: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        _, classes, least, vectors = part
        for asked, low, high, covered in block(part, rows):
            if low == high:
                continue
            q, i, score = _listed(np.array([r[5] for r in asked]), vectors[low:high], least[low:high], np.array([r[4] for r in asked]), k)
            names = np.array([r[0] for r in asked], dtype=np.int64)
            for held, new in zip(out, (names[q], classes[low:high][i], least[low:high][i], score, np.full(len(q), covered)), strict=True):
                held.append(new)
        if out[0]:
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["query", "class", "least", "score", "covered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        now, held, part, asked = None, [], None, []
        for b in batches:
            vectors = matrix(b.column(9), dims)
            columns = [b.column(c).to_pylist() for c in range(9)]
            for at, (number, way, side, key, name, least, low, high, floor) in enumerate(zip(*columns, strict=True)):
                if (number, way) != now:
                    if part is not None and asked:
                        yield from answers(part, asked)
                    now, held, part, asked = (number, way), [], None, []
                if side == 0:
                    held.append((key, name, least, vectors[at]))
                    continue
                if part is None:
                    part = (*(np.array([h[c] for h in held], dtype=np.int64) for c in range(3)), np.array([h[3] for h in held]).reshape(len(held), dims))
                    held = []
                asked.append((name, key, low, high, floor, vectors[at]))
                if len(asked) >= 16 * _BLOCK:
                    yield from answers(part, asked)
                    asked = []
        if part is not None and asked:
            yield from answers(part, asked)

    ways = written(queries.groupBy("part").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("ways")))
    left = items.join(ways.hint("merge"), "part").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    right = queries.join(ways.hint("merge"), "part").withColumn("way", F.pmod(F.xxhash64("query"), F.col("ways")).cast("int"))
    null = F.lit(None).cast("long")
    both = left.select("part", "way", F.lit(0).alias("side"), "key", F.col("class").alias("name"), "least", null.alias("low"), null.alias("high"), F.lit(None).cast("double").alias("floor"), "vector")
    both = both.unionByName(right.select("part", "way", F.lit(1).alias("side"), "key", F.col("query").alias("name"), null.alias("least"), "low", "high", "floor", "vector"))
    return both.repartition("part", "way").sortWithinPartitions("part", "way", "side", "key", "least").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` classes of each query, met once or more often: query, class, least, score, place."""
    once = found.groupBy("query", "class").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "least")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


class Forest:
    """The index: classes of equal vectors with their keys, and where the parts of the sorted trees begin.

    ``classes``: class, f1, f2 (hashes of the vector), least (id), docs, asking, vector.
    """

    def __init__(self, classes: DataFrame, trees: int, seed: int, part_rows: int):
        self.spark, self.trees = classes.sparkSession, trees
        size, dims, top = classes.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).head()
        self.size, self.dims, self.top = size, dims or 0, float(top or 1)
        squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (x / self.top) * (x / self.top))
        self.longest = float(np.sqrt(classes.agg(F.max(squares)).head()[0] or 1.0))
        self.normals = self.spark.sparkContext.broadcast(planes(self.dims, trees, seed))
        self.items = written(self._keyed(classes.select("class", "least", "vector"), query=False))
        rows = max(part_rows, -(-trees * size // PARTS))
        places = self.items.select(F.explode("keys").alias("key"), "class", F.lit(1).cast("long"))
        self.ranges = self.spark.sparkContext.broadcast(byte_ranges(places, rows))

    def _keyed(self, rows: DataFrame, query: bool) -> DataFrame:
        """``rows``, whose last column is ``vector``, with ``keys``, one a tree."""
        names = [*rows.columns, "keys"]
        at, sent, trees, dims, top, longest = len(names) - 2, self.normals, self.trees, self.dims, self.top, self.longest

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept(None)
            for b in batches:
                keys = strings(on_sphere(matrix(b.column(at), dims), top, longest, query), sent.value, trees)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), trees).cast(pa.list_(pa.int64()))], names=names)

        return rows.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", keys array<long>")

    def _part(self, key: Column, second: Column) -> Column:
        sent = self.ranges

        @F.arrow_udf("long")
        def part(first: pa.Array, second: pa.Array) -> pa.Array:
            return pa.array(sent.value.of(first.to_numpy(), second.to_numpy()))

        return part(key, second)

    def parts(self) -> DataFrame:
        """The sorted trees, by part."""
        return self.items.select("class", "least", "vector", F.explode("keys").alias("key")).withColumn("part", self._part(F.col("key"), F.col("class")))

    def search(self, asking: DataFrame, k: int, miss: float, beside: int) -> DataFrame:
        """The first ``k`` classes of each query. ``asking``: query, vector. Returns query, class, least, score, place."""
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (x / self.top) * (x / self.top)))
        asked = written(self._keyed(asking.select("query", (norm * self.longest * self.top * self.top).alias("span"), "vector"), query=True))
        null, first, last = F.lit(None).cast("long"), F.lit(-(2**63)), F.lit(2**63 - 1)
        descent = asked.select("query", "vector", F.explode("keys").alias("key")).withColumns({"part": self._part(F.col("key"), first), "low": null, "high": null, "floor": F.lit(float("-inf"))})
        met = written(_visits(self.parts(), descent, k, beside, self.dims))
        best = written(_best(met, k))
        floors = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        covered = met.groupBy("query").agg(F.max("covered").alias("covered"))
        full = F.col("n") >= k
        level = F.when(full, levels(F.col("floor") / F.col("span"), self.trees, miss)).otherwise(0)
        state = asked.join(floors.hint("merge"), "query").join(covered.hint("merge"), "query").withColumns({"level": level, "floor": F.when(full, F.col("floor")).otherwise(F.lit(float("-inf")))})
        width = F.expr(f"shiftleft(1L, {BITS} - level)")
        up = state.filter(F.col("level") < F.col("covered")).select("query", "vector", "floor", "level", F.explode("keys").alias("key"))
        up = up.withColumn("low", F.col("key") - F.pmod(F.col("key"), width)).withColumn("high", F.col("low") + width)
        up = written(up.withColumns({"from": self._part(F.col("low"), first), "to": self._part(F.col("high") - 1, last)}))
        routed = up.withColumn("part", F.explode(F.sequence("from", "to")))
        more = _visits(self.parts(), routed, k, beside, self.dims)
        return _best(best.select("query", "class", "least", "score").unionByName(more.drop("covered")), k)


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, miss: float = MISS, beside: int = BESIDE, part_rows: int = PART_ROWS, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest rows, by inner product, that a hash-prefix forest finds for each query.

    ``queries``: a condition on ids. Rows with a null id, or a vector that is null, zero or
    holds null or non-finite components, take no part; shorter vectors are filled with
    zeros. Of rows that share an id, the one with the least vector takes part; so repeated
    rows count once. A query meets all rows but its own, those of equal vectors included.

    Returns ``query_id``, ``rank`` int from 1, ``vec_id`` (longs), ``score`` double: the
    inner product of the original vectors, added up in order of the components. Higher
    scores come first, equal ones by id. With at most ``k`` other rows, all are returned.
    A query's last neighbour is missed with a chance of about ``miss``, nearer ones with
    less. An empty table gives no rows. Other columns are not read.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), number_array(vectors, vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    own = own.filter(F.col("id").isNotNull() & finite(F.col("vector"))).filter(F.exists("vector", lambda x: x != 0))
    one = own.groupBy("id").agg(F.min(F.struct("vector", "asks")).alias("row")).select("id", "row.*")
    rows = written(one.select("id", "asks", F.xxhash64("vector").alias("f1"), F.xxhash64(F.lit(1), "vector").alias("f2"), "vector"))
    grouped = rows.groupBy("f1", "f2").agg(F.min("id").alias("least"), F.count("*").alias("docs"), F.count_if("asks").alias("asking"), F.first("vector").alias("vector"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("class"), "*"))
    if classes.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(classes, trees, seed, part_rows)
    found = written(forest.search(classes.filter("asking > 0").select(F.col("class").alias("query"), "vector"), k + 1, miss, beside))
    # Of a class, the k + 1 least ids are enough: one may be the query's own.
    several = rows.select("id", "f1", "f2").join(classes.filter("docs > 1").select("f1", "f2").hint("merge"), ["f1", "f2"], "left_semi")
    ranked = several.withColumn("n", F.row_number().over(Window.partitionBy("f1", "f2").orderBy("id"))).filter(F.col("n") <= k + 1)
    many = ranked.groupBy("f1", "f2").agg(F.collect_list("id").alias("ids"))
    named = classes.select("class", "f1", "f2", "least").join(many.hint("merge"), ["f1", "f2"], "left").select("class", F.coalesce("ids", F.array("least")).alias("ids"))
    uses = written(found.groupBy("class").agg(F.count("*").alias("uses")).join(named.hint("merge"), "class"))
    expanded = look_up_spread(found.select("query", "class", "score"), uses, ["class"], "uses", found.count()).select("query", "score", F.explode("ids").alias("id"))
    first = expanded.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))).filter(F.col("n") <= k + 1)
    lists = first.groupBy(F.col("query").alias("class")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("list"))
    answers = written(lists.join(classes.select("class", "f1", "f2", "asking").hint("merge"), "class").drop("class"))
    asked = rows.filter("asks").select("id", "f1", "f2")
    each = look_up_spread(asked, answers, ["f1", "f2"], "asking", asked.count())
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("id")), 1, k)
    out = each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
