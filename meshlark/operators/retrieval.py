"""Vector and keyword search, and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import ROWS, pieces
from ..functions.vectors import METRICS
from ..sources.lineage import cut_lineage, shared_folder
from .keyword_tiles import Asking, blocks


class UnknownCollection(KeyError):
    """No keyword collection has that name."""


#: Numbers in one matrix of scores or weights: about 32 MB.
CELLS = 4_000_000
#: Sets of terms that one reading of the texts looks for, those that a task answers, and the entries of all their lists.
SETS, QUERIES, ENTRIES = 1 << 20, 65_536, 819_200


def _order(ids: pa.Array) -> np.ndarray:
    """The places of ids in ascending order, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()


class _Lists:
    """The ``top`` best items of each of ``many`` lists, fed piece by piece; ties by id, null first.

    Scores below the last one of a full list are left out at once, so a task holds and sends
    on little more than its lists, however many items it reads.
    """

    def __init__(self, many: int, top: int):
        self.top, self.room = top, max(CELLS // 16, 4 * many * top)
        self.least, self.parts, self.held = np.full(many, -np.inf), [], 0

    def add(self, ids: pa.Array, score: np.ndarray, first: int = 0, low: float = -np.inf, digits: int | None = None) -> None:
        """``score``: items x lists from number ``first`` on; scores over ``low`` count, rounded (half up) to ``digits``."""
        least, slack = self.least[first : first + score.shape[1]], 0.0 if digits is None else 10.0**-digits
        fit = (score >= least - slack) & (score > low)
        if len(score) > self.top > 0 and np.count_nonzero(fit) > 2 * self.top * score.shape[1]:
            fit &= score >= np.partition(score, -self.top, axis=0)[-self.top] - slack
        rows, cols = np.nonzero(fit)
        s = score[rows, cols]
        if digits is not None:
            s = np.floor(s * 10.0**digits + 0.5) / 10.0**digits
            rows, cols, s = (x[(s >= least[cols]) & (s > low)] for x in (rows, cols, s))
        if len(rows):
            self.parts.append((cols + first, ids.take(pa.array(rows)), s))
            self.held += len(rows)
            if self.held > self.room:
                self.cut()

    def put(self, lists: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        """Single items of lists, with their final scores."""
        self.parts.append((lists, ids, score))
        self.held += len(lists)
        if self.held > self.room:
            self.cut()

    def cut(self) -> None:
        lists, ids, score = np.concatenate([p[0] for p in self.parts]), pa.concat_arrays([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts])
        order = np.lexsort((_order(ids), -score, lists))
        at = lists[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        last = order[place == self.top - 1]
        self.least[lists[last]] = score[last]
        kept = order[place < self.top]
        self.parts, self.held = [(lists[kept], ids.take(pa.array(kept)), score[kept])], len(kept)

    def batches(self, names: list[str], constant: int | None = None) -> Iterator[pa.RecordBatch]:
        """(number of the list, item, score) of what is held, behind a column of a constant if one is given."""
        if not self.parts:
            return
        self.cut()
        lists, ids, score = self.parts[0]
        before = [] if constant is None else [pa.array(np.full(len(lists), constant), pa.int32())]
        for part in pieces([pa.RecordBatch.from_arrays([*before, pa.array(lists, pa.int32()), ids, pa.array(score)], names=names)], rows=10_000):
            yield part


def _named(found: DataFrame, ids: list, kind: str, query_id: str) -> DataFrame:
    """Puts the ids of the queries for their numbers in ``_q``."""
    names = found.sparkSession.createDataFrame(list(enumerate(ids)), f"_q int, `{query_id}` {kind}")
    return found.join(F.broadcast(names), "_q").drop("_q")


def _similarities(items: list, queries: list[np.ndarray], metric: str) -> np.ndarray:
    """Items x queries; 0 where lengths differ, or where a cosine has no direction."""
    out = np.zeros((len(items), len(queries)))
    lengths, wanted = np.array([len(v) if v is not None else 0 for v in items]), np.array([len(v) for v in queries])
    for d in set(lengths.tolist()) & set(wanted.tolist()) - {0}:
        r, q = np.flatnonzero(lengths == d), np.flatnonzero(wanted == d)
        a, b = np.array([items[i] for i in r.tolist()], dtype=float), np.stack([queries[i] for i in q.tolist()])
        if metric == "l2":
            got = np.stack([1 / (1 + np.linalg.norm(a - x, axis=1)) for x in b], axis=1)
        else:
            got = a @ b.T
        if metric == "cosine":
            size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
            got = np.divide(got, size, out=np.zeros_like(got), where=size > 0)
        out[np.ix_(r, q)] = got
    return np.round(out, 12)  # equal vectors tie, whatever the order of their sums


def nearest(queries: DataFrame, items: DataFrame, top: int, metric: str = "cosine", least: float | None = None, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector", block: int = 4096) -> DataFrame:
    """The ``top`` nearest items of each query: query_id, item_id, score, rank.

    Items stay where they are. The queries, a stated set, are sent to them in blocks of
    ``block``, each a scan; a task keeps the best of all that it reads, so no more than
    these are shuffled. Ties go to the lower id. Scores are rounded to twelve digits.
    """
    metric = metric if metric in METRICS else "cosine"
    asked = [(r[0], np.array(r[1] if r[1] is not None else [], dtype=float)) for r in queries.select(query_id, vector).toLocalIterator()]
    spark, kinds = items.sparkSession, [x.schema[c].dataType.simpleString() for x, c in ((queries, query_id), (items, item_id))]
    out = None
    for i in range(0, max(1, len(asked)), block):
        sent = spark.sparkContext.broadcast([v for _, v in asked[i : i + block]])

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lists = _Lists(len(sent.value), top)
            for b in pieces(batches, rows=min(ROWS, max(1, CELLS // len(sent.value)))) if sent.value else ():
                score = _similarities(b.column(1).to_pylist(), sent.value, metric)
                lists.add(b.column(0), score if least is None else np.where(score >= least, score, -np.inf))
            yield from lists.batches(["_q", "item", "score"])

        found = items.select(F.col(item_id).alias("item"), F.col(vector).alias("vector")).mapInArrow(task, f"_q int, item {kinds[1]}, score double").withColumnRenamed("item", item_id)
        found = _named(found, [q for q, _ in asked[i : i + block]], kinds[0], query_id)
        out = found if out is None else out.unionByName(found)
    return ranked(out, query_id, item_id, top).select(query_id, item_id, "score", "rank")


class _Held:
    """Which terms (without blanks) a text holds anywhere.

    A term can only lie within one of the text's words, cut at blanks. A word's parts as long
    as some term are looked up, so its cost does not grow with the number of terms, and what
    short words hold is remembered.
    """

    def __init__(self, terms: dict[str, int], most: int = 100_000):
        self.terms, self.most, self.known = terms, most, {}
        self.lengths = sorted(set(map(len, terms)))

    def _within(self, word: str) -> list[int]:
        get, n = self.terms.get, len(word)
        return list({i for k in self.lengths if k <= n for at in range(n - k + 1) if (i := get(word[at : at + k])) is not None})

    def by(self, text: str) -> list[int]:
        out: set[int] = set()
        for word in set(text.split(" ")):
            found = self.known.get(word)
            if found is None:
                found = self._within(word)
                if len(word) <= 64:
                    if len(self.known) >= self.most:
                        self.known.clear()
                    self.known[word] = found
            out.update(found)
        return sorted(out)


def overlap_scores(queries: DataFrame, docs: DataFrame, top: int, query_id: str = "query_id", query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The ``top`` documents of each query by keyword overlap: query_id, doc_id, score, rank.

    The score is that of ``keyword_overlap``. The queries, a stated set, are sent to the
    documents in blocks of bounded size, each a scan; each distinct word of a text is
    searched once for all terms, and a task keeps the best of all that it reads.
    """
    spark = docs.sparkSession
    asked = [(q, [t for t in (text or "").lower().split(" ") if t]) for q, text in queries.select(query_id, query_text).toLocalIterator()]
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((queries, query_id), (docs, doc_id))]
    blocks, words = [[]], set()
    for q, terms in asked:
        if blocks[-1] and len(words | set(terms)) * (len(blocks[-1]) + 1) > CELLS:
            blocks.append([])
            words = set()
        blocks[-1].append((q, terms))
        words |= set(terms)
    out = None
    for block in blocks:
        sent = spark.sparkContext.broadcast([terms for _, terms in block])

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms = sorted(set().union(*map(set, sent.value)))
            at = {t: i for i, t in enumerate(terms)}
            share = np.zeros((len(terms), len(sent.value)))
            for q, mine in enumerate(sent.value):
                for t in mine:
                    share[at[t], q] += 1
            many = np.array([max(1, len(x)) for x in sent.value])
            held, lists = _Held(at), _Lists(len(sent.value), top)
            for b in pieces(batches, 1, min(ROWS, max(1, CELLS // len(sent.value)))) if sent.value else ():
                score = np.zeros((b.num_rows, len(sent.value)))
                for row, text in enumerate(b.column(1).to_pylist()):
                    score[row] = share[held.by((text or "").lower())].sum(axis=0)
                lists.add(b.column(0), np.floor(score / many * 1e6 + 0.5) / 1e6)
            yield from lists.batches(["_q", "doc", "score"])

        found = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).mapInArrow(task, f"_q int, doc {kinds[1]}, score double").withColumnRenamed("doc", doc_id)
        found = _named(found, [q for q, _ in block], kinds[0], query_id)
        out = found if out is None else out.unionByName(found)
    return ranked(out, query_id, doc_id, top).select(query_id, doc_id, "score", "rank")


_STOPS = bytes.maketrans(b".,;:!?", b"      ")


def _terms(text: str | None) -> list[bytes]:
    """Runs without ASCII blanks and stops, in lower case and UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_STOPS).split()


def _term_sets(queries: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of terms of queries with a number each (_q, terms), and the queries that ask for them (_q, q)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [b" ".join(sorted(set().union(*map(_terms, texts)))) for texts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["q", "terms"])

    texts = queries.select(F.col(query_id).alias("q"), F.col(query_text).alias("text")).groupBy("q").agg(F.collect_list("text").alias("texts"))
    asked = cut_lineage(texts.mapInArrow(task, f"q {queries.schema[query_id].dataType.simpleString()}, terms binary").filter(F.length("terms") > 0))
    sets = cut_lineage(asked.select("terms").distinct().withColumn("_q", F.monotonically_increasing_id()))
    return sets, asked.join(sets, "terms").select("_q", "q")


def _counted(docs: DataFrame, doc_id: str, doc_text: str, vocabulary: Broadcast) -> DataFrame:
    """Documents as doc, len (in terms), terms and tf (of those in the vocabulary), written to the shared folder."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, many = vocabulary.value.get, max(1, len(vocabulary.value))
        for b in pieces(batches, 1):
            found, ends, length = [], [0], []
            for text in b.column(1).to_pylist():
                words = _terms(text)
                found += [i for i in map(place, words) if i is not None]
                ends.append(len(found))
                length.append(len(words))
            key, tf = np.unique(np.repeat(np.arange(b.num_rows), np.diff(ends)) * many + np.array(found, dtype=np.int64), return_counts=True)
            rows, terms = np.divmod(key, many)
            first = pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int32()), *lists], names=["doc", "len", "terms", "tf"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out, path = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).mapInArrow(task, f"doc {kind}, len int, terms array<int>, tf array<int>"), shared_folder(docs.sparkSession)
    out.write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _frequencies(counted: DataFrame, many: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each of ``many`` terms occurs, how many documents there are, and their terms; summed by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, terms = np.zeros(many, dtype=np.int64), 0, 0
        for b in batches:
            seen += np.bincount(b.column(1).flatten().to_numpy(), minlength=many)
            docs, terms = docs + b.num_rows, terms + (pc.sum(b.column(0)).as_py() or 0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2], pa.int64()), pa.array(np.r_[seen[at], docs, terms], pa.int64())], names=["term", "n"])

    got = counted.select("len", "terms").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (got.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(many)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term == -1].sum()), int(n[term == -2].sum())


def bm25_lists(queries: DataFrame, docs: DataFrame, top: int, rankings: list[tuple[float, float]], query_id: str = "query_id", query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """Okapi BM25 over all documents, once for each (k1, b): list, query_id, doc_id, score, rank.

    Texts are read and cut once for each ``SETS`` distinct sets of query terms; what counts of
    them is a table in the shared folder. Documents are dealt by their ids, whatever words they
    hold. Sets of terms are sent to them, ``QUERIES`` or fewer to a task, which keeps the best
    of all documents that it reads (``keyword_tiles``). Repeated terms of a query count once,
    rows with one query id are one query, queries with the same terms are answered once.
    Documents without any of a query's terms are not in its lists. Scores are rounded to six digits.
    """
    spark = docs.sparkSession
    sets, links = _term_sets(queries, query_id, query_text)
    many = min(QUERIES, max(1, ENTRIES // (max(1, top) * len(rankings))))
    schema = f"list int, _q long, doc {docs.schema[doc_id].dataType.simpleString()}, score double"
    out, rows = None, iter(sets.toLocalIterator())
    while asked := [(r["_q"], r["terms"]) for r in islice(rows, SETS)]:
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(terms.split(b" ") for _, terms in asked))))}
        counted = _counted(docs, doc_id, doc_text, spark.sparkContext.broadcast(vocabulary))
        df, n, total = _frequencies(counted, len(vocabulary))
        mean = total / n if n else 1.0
        shared = spark.sparkContext.broadcast((df, np.log(1 + (n - df + 0.5) / (df + 0.5))))
        parts = max(1, min(spark.sparkContext.defaultParallelism, n // ROWS))
        # Lengths near the mean come first: lists fill with good scores, and a block's weights are alike.
        dealt = counted.filter(F.size("terms") > 0).repartition(parts, "doc").sortWithinPartitions(F.abs(F.col("len") - mean))
        for at in range(0, len(asked), many):
            terms = [np.array([vocabulary[w] for w in terms.split(b" ")], dtype=np.int32) for _, terms in asked[at : at + many]]
            numbers = np.array([q for q, _ in asked[at : at + many]], dtype=np.int64)
            sent = spark.sparkContext.broadcast((numbers, np.concatenate(terms), np.cumsum([0, *map(len, terms)])))

            def task(batches: Iterator[pa.RecordBatch], sent=sent, shared=shared, n=n, mean=mean) -> Iterator[pa.RecordBatch]:
                if top <= 0:
                    return
                (numbers, terms, ends), (df, idf) = sent.value, shared.value
                asking = Asking(terms, ends, df, n, top)
                lists = [(_Lists(len(numbers), top), asking.lists()) for _ in rankings]
                for b in blocks(batches, asking.docs, 2):
                    rows, terms, tf = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy()), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
                    length = b.column(1).to_numpy()[rows]
                    for (k1, b_), (mine, best) in zip(rankings, lists, strict=True):
                        weights = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * length / mean))
                        for q, d, score in asking.found(best, b.num_rows, rows, terms, weights):
                            mine.put(q, b.column(0).take(pa.array(d)), score)
                for i, (mine, _) in enumerate(lists):
                    for part in mine.batches(["list", "_q", "doc", "score"], i):
                        yield part.set_column(1, "_q", pa.array(numbers[part.column(1).to_numpy()]))

            found = dealt.mapInArrow(task, schema)
            out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    place = F.row_number().over(Window.partitionBy("list", "_q").orderBy(F.col("score").desc(), "doc"))
    best = out.withColumn("rank", place).filter(F.col("rank") <= top).join(links, "_q")
    return best.select("list", F.col("q").alias(query_id), F.col("doc").alias(doc_id), "score", "rank")


def bm25(queries: DataFrame, docs: DataFrame, top: int, query_id: str = "query_id", query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``bm25_lists`` with one ranking: query_id, doc_id, score, rank."""
    return bm25_lists(queries, docs, top, [(k1, b)], query_id, query_text, doc_id, doc_text).drop("list")


def ranked(scored: DataFrame, query_id: str, doc_id: str, top: int | None = None, score: str = "score") -> DataFrame:
    """Ranks from 1 within each query, score descending, ties by id."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.col(score).desc(), doc_id)))
    return out if top is None else out.filter(F.col("rank") <= top)


def keyword_search(queries: DataFrame, collections: dict[str, DataFrame], collection: str, top: int, metadata: dict[str, str] | None = None, **columns) -> DataFrame:
    """BM25 over a named collection; ``metadata`` keeps documents whose map column has all those pairs."""
    if collection not in collections:
        raise UnknownCollection(collection)
    docs = collections[collection]
    for k, v in (metadata or {}).items():
        docs = docs.filter(F.coalesce(F.try_element_at("metadata", F.lit(k)) == v, F.lit(False)))
    return bm25(queries, docs, max(top, 0), **columns)


def _weighted(lists: list[DataFrame], weights: list[float] | None) -> list[tuple[DataFrame, float]]:
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists) or any(w < 0 for w in weights):
        raise ValueError("one weight of at least 0 for each list")
    return [(x, w) for x, w in zip(lists, weights, strict=True) if w > 0]


def _fused(parts: list[DataFrame], query_id: str, doc_id: str, top: int) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return ranked(rows.groupBy(query_id, doc_id).agg(F.sum("_part").alias("fused_score")), query_id, doc_id, top, "fused_score")


def reciprocal_rank_fusion(lists: list[DataFrame], top: int, k: int = 60, weights: list[float] | None = None, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Sum of weight / (k + rank) over lists with (query, document, rank): adds fused_score and rank.

    Lists of weight 0 add nothing, not even their documents.
    """
    if k <= 0:
        raise ValueError("k is positive")
    parts = [x.select(query_id, doc_id, (F.lit(w) / (k + F.col("rank"))).alias("_part")) for x, w in _weighted(lists, weights)]
    if not parts:
        return lists[0].select(query_id, doc_id, F.lit(0.0).alias("fused_score"), F.lit(0).alias("rank")).limit(0)
    return _fused(parts, query_id, doc_id, top)


def distribution_fusion(lists: list[DataFrame], top: int, weights: list[float] | None = None, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Sum of weight * (score - (mean - 3 sd)) / (6 sd) over lists with (query, document, score).

    Mean and sample deviation are those of a list's scores for a query; with one score, or
    a deviation below 1e-9, the part is 0.5. Not clamped.
    """
    parts = []
    for x, w in _weighted(lists, weights):
        by = Window.partitionBy(query_id)
        m = x.withColumn("_m", F.avg("score").over(by)).withColumn("_s", F.stddev_samp("score").over(by))
        flat = F.col("_s").isNull() | (F.col("_s") < 1e-9)
        part = F.when(flat, 0.5).otherwise(F.try_divide(F.col("score") - (F.col("_m") - 3 * F.col("_s")), 6 * F.col("_s")))
        parts.append(m.select(query_id, doc_id, (F.lit(w) * part).alias("_part")))
    if not parts:
        return lists[0].select(query_id, doc_id, F.lit(0.0).alias("fused_score"), F.lit(0).alias("rank")).limit(0)
    return _fused(parts, query_id, doc_id, top)


@dataclass(frozen=True)
class HybridOptions:
    """How a dense and a keyword list are combined. ``weights``: dense, sparse."""

    dense_top: int = 50
    sparse_top: int = 50
    k: int = 60
    method: str = "rrf"
    weights: tuple[float, ...] | None = None
    keyword: bool = True
    saturation: float = 18.0  # reported only

    def __post_init__(self):
        if self.weights is not None and len(self.weights) != 2:
            raise ValueError("two weights, dense and sparse")
        if min(self.dense_top, self.sparse_top, self.k) <= 0:
            raise ValueError("sizes are positive")


def hybrid(dense: DataFrame, sparse: DataFrame | None, top: int, options: HybridOptions | None = None, query_id: str = "query_id", doc_id: str = "doc_id") -> tuple[DataFrame, dict]:
    """Dense rows in fused order, with their dense score, and what was done.

    Both lists have query, document, score, rank. Documents of the keyword list alone are
    left out. Without a keyword list, or with an empty one, the dense order stays. A list
    that fails fails the call: dense rows alone would look like a fused result.
    """
    o = options or HybridOptions()
    dense = dense.withColumn("_first", F.row_number().over(Window.partitionBy(query_id, doc_id).orderBy("rank"))).filter("_first = 1").drop("_first").filter(F.col("rank") <= max(o.dense_top, top))
    plain = dense.filter(F.col("rank") <= top).select(query_id, doc_id, "score", "rank")
    if not o.keyword:
        return plain, {"hybrid": False, "degraded": None}
    if sparse is None:
        return plain, {"hybrid": False, "degraded": "no-keyword-provider"}
    # At most ``sparse_top`` rows a query, computed once for the test and for the fusion.
    sparse = cut_lineage(sparse.filter(F.col("rank") <= o.sparse_top))
    if sparse.isEmpty():
        return plain, {"hybrid": False, "degraded": "sparse-empty"}
    lists, weights = [dense, sparse], list(o.weights) if o.weights else None
    fuse = reciprocal_rank_fusion(lists, top, o.k, weights, query_id, doc_id) if o.method == "rrf" else distribution_fusion(lists, top, weights, query_id, doc_id)
    out = fuse.select(query_id, doc_id, "fused_score", "rank").join(dense.select(query_id, doc_id, "score"), [query_id, doc_id])
    return out.select(query_id, doc_id, "score", "rank"), {"hybrid": True, "degraded": None, "method": o.method, "saturation": o.saturation}
