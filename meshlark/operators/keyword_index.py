"""A stored keyword index: postings by term and chunk of documents, with maxima to prune by.

A segment deals its documents into chunks of about ``CHUNK``. A row of the postings holds
what one term has in one chunk, with the largest frequency and the least length there,
which bound every score in it. Rows are range-partitioned by term and chunk, so a frequent
term is spread over many files and a rare one is found by the statistics of its file.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import pieces
from ..sources.lineage import cut_lineage

CHUNK = 4096
#: Chunks of a query that are scored first, for a score that its list reaches at least.
FIRST = 2
_TERM = re.compile(r"[^ \t\n\x0b\f\r.,;:!?]+")


def _terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


class KeywordIndex:
    """An index in ``folder``, which all executors share. Segments are added and never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", chunk: int = CHUNK) -> None:
        """Adds documents as a segment. Each row is a document; null texts have no terms.

        A segment is complete once its line in ``segments`` is written, which comes last, so
        a build that is broken off leaves nothing that a search would read.
        """
        name, kind = uuid.uuid4().hex, docs.schema[doc_id].dataType.simpleString()
        chunks = max(1, -(-docs.count() // chunk))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 2):
                counts = [Counter(_terms(t)) for t in b.column(2).to_pylist()]
                at = np.repeat(np.arange(b.num_rows), [max(1, len(c)) for c in counts])
                lens = np.array([sum(c.values()) for c in counts], dtype=np.int32)
                pairs = [p for c in counts for p in (c.items() or [(None, 0)])]  # a row without a term keeps an empty text counted
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32()), pa.array(lens[at], pa.int32())],
                    names=["chunk", "doc", "term", "tf", "len"],
                )

        part = F.pmod(F.xxhash64(doc_id, F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
        terms = docs.select(part.alias("chunk"), F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).mapInArrow(cut, f"chunk int, doc {kind}, term string, tf int, len int")
        rows = terms.groupBy("term", "chunk").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.count("*").alias("n"), F.sum("tf").alias("tokens"), F.collect_list(F.struct("doc", "tf", "len")).alias("postings"))
        out = rows.select("term", "chunk", "max_tf", "min_len", "n", "tokens", F.col("postings.doc").alias("docs"), F.col("postings.tf").alias("tfs"), F.col("postings.len").alias("lens"))
        path = f"{self.folder}/postings/{name}"
        out.repartitionByRange("term", "chunk").sortWithinPartitions("term", "chunk").write.parquet(path)
        total = self.spark.read.parquet(path).agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
        line = self.spark.createDataFrame([(name, docs.count(), total)], "segment string, docs long, tokens long")
        line.coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")

    def postings(self) -> tuple[DataFrame, int, int]:
        """All segments' postings with the chunks named by segment; the numbers of documents and of terms."""
        made = self.spark.read.parquet(f"{self.folder}/segments").collect()  # a row a segment
        out = None
        for s in made:
            rows = self.spark.read.parquet(f"{self.folder}/postings/{s['segment']}").withColumn("chunk", F.concat_ws(".", F.lit(s["segment"]), "chunk"))
            out = rows if out is None else out.unionByName(rows)
        return out, sum(s["docs"] for s in made), sum(s["tokens"] for s in made)

    def search(self, queries: DataFrame, top: int, query_id: str = "query_id", query_text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The ``top`` documents of each query by Okapi BM25: query_id, doc_id, score, rank.

        Equals ``retrieval.bm25`` over all documents appended. Only postings of the queries'
        terms are read. The chunks that may hold a query's best are scored first; a chunk
        whose bound is below the last score of that list is left out. The queries are a
        stated set: their terms come to the driver. Ties go to the lower id.
        """
        rows, n, total = self.postings()
        kind, mean = rows.schema["docs"].dataType.elementType.simpleString(), total / n if total else 1.0
        asked: dict = {}
        for q, text in queries.select(query_id, query_text).toLocalIterator():
            asked.setdefault(q, set()).update(_terms(text))
        names = {q: i for i, q in enumerate(asked)}
        rows = rows.filter(F.col("term").isin(sorted(set().union(*asked.values())) if asked else []))
        df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        wants = [(t, names[q], idf[t]) for q, terms in asked.items() for t in terms if t in idf]
        wanted = self.spark.createDataFrame(wants, "term string, _q int, idf double")
        # Bounds: every term of a query as frequent as anywhere in the chunk, in its shortest text.
        bound = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_len") / mean))
        bounds = cut_lineage(rows.select("term", "chunk", "max_tf", "min_len").join(F.broadcast(wanted), "term").groupBy("_q", "chunk").agg(F.sum(bound).alias("bound")))
        order = Window.partitionBy("_q").orderBy(F.col("bound").desc(), "chunk")
        first = bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FIRST).select("_q", "chunk")
        found = cut_lineage(self._scored(rows, wanted, first, top, kind, mean, k1, b))
        place = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), "doc_id"))
        least = found.withColumn("rank", place).filter(F.col("rank") == top).select("_q", F.col("score").alias("least"))
        rest = bounds.join(first, ["_q", "chunk"], "left_anti").join(F.broadcast(least), "_q", "left")
        # A chunk that only ties may hold a lower id; scores are rounded to six digits.
        rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("_q", "chunk")
        every = found.unionByName(self._scored(rows, wanted, rest, top, kind, mean, k1, b))
        best = every.withColumn("rank", place).filter(F.col("rank") <= top)
        ids = self.spark.createDataFrame([(i, q) for q, i in names.items()], f"_q int, `{query_id}` {queries.schema[query_id].dataType.simpleString()}")
        return best.join(F.broadcast(ids), "_q").select(query_id, "doc_id", "score", "rank")

    def _scored(self, rows: DataFrame, wanted: DataFrame, pairs: DataFrame, top: int, kind: str, mean: float, k1: float, b: float) -> DataFrame:
        """The best ``top`` documents of each query and chunk of ``pairs``: _q, doc_id, score. A task holds a chunk."""

        def best(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            qs = sorted({q for _, asking, *_ in held for q in asking})
            at = {q: i for i, q in enumerate(qs)}
            named = pa.concat_arrays([these for *_, these, _, _ in held]).dictionary_encode(null_encoding="encode")
            ids, places, start = named.dictionary, named.indices.to_numpy(), 0
            score = np.zeros((len(ids), len(qs)))
            for idf, asking, these, tfs, lens in held:
                tf = tfs.to_numpy().astype(float)
                part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens.to_numpy() / mean))
                mine, start = places[start : start + len(these)], start + len(these)
                score[mine[:, None], [at[q] for q in asking]] += part[:, None]
            score = np.floor(score * 1e6 + 0.5) / 1e6
            order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
            for q, i in at.items():
                s = score[:, i]
                some = np.flatnonzero(s > 0)
                if len(some) > top:
                    some = some[s[some] >= np.partition(s[some], -top)[-top]]
                some = some[np.lexsort((order[some], -s[some]))[:top]]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q), pa.int32()), ids.take(pa.array(some)), pa.array(s[some])], names=["_q", "doc_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                lists = [(c.values, c.offsets.to_numpy()) for c in batch.columns[3:]]
                for i, (chunk, idf, asking) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                    if chunk != now:
                        if held:
                            yield from best(held)
                        now, held = chunk, []
                    # Postings stay Arrow slices: as Python numbers they take some ten times the memory.
                    held.append((idf, asking, *(values.slice(ends[i], ends[i + 1] - ends[i]) for values, ends in lists)))
            if held:
                yield from best(held)

        # Which queries of the chunk ask for the term: at most the stated set.
        asking = pairs.join(F.broadcast(wanted), "_q").groupBy("chunk", "term").agg(F.first("idf").alias("idf"), F.sort_array(F.collect_list("_q")).alias("asking"))
        held = rows.join(asking, ["chunk", "term"]).select("chunk", "idf", "asking", "docs", "tfs", "lens", "term")
        return held.repartition("chunk").sortWithinPartitions("chunk", "term").drop("term").mapInArrow(run, f"_q int, doc_id {kind}, score double")
