"""Work and memory of tasks over long texts: pieces, lists and searches stay in bounds."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meshlark.functions import batches
from meshlark.operators import chunking, retrieval
from meshlark.plans import base, retrieval_queries

SF = "/root/testdata/sf0.001"


def test_batches_of_texts_come_in_pieces():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 10_000, None] * 500)], names=["id", "text"])
    got = list(batches.pieces([b, b.slice(0, 0)], 1))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([b])) and max(p.num_rows for p in got) <= batches.ROWS
    long = pa.RecordBatch.from_arrays([pa.array(["y" * batches.BYTES] * 3)], names=["text"])
    assert [p.num_rows for p in batches.pieces([long], 0)] == [1, 1, 1]


def test_queries_over_texts_use_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for query in ("chunk_sentences", "chunk_fixed_counts", "ingest_embeddings", "keyword_overlap_topk", "rrf_weighted", "hybrid_rrf", "hybrid_dbsf", "keyword_index_topk"):
        spark.conf.set(name, "10000")
        retrieval_queries.C.queries[query](spark, SF)
        assert spark.conf.get(name) == "512", query
    spark.conf.set(name, before)


def test_lists_over_many_pieces():
    """Ties go to the lower id, across cuts and from full lists."""
    lists, rows = retrieval._Lists(2, 3), []
    lists.room = 20
    for at in range(0, 400, 8):
        ids = [(i * 37) % 400 for i in range(at, at + 8)]
        score = [[(i % 5) / 4, (i % 7) / 6] for i in ids]
        rows += [(q, -s[q], i) for i, s in zip(ids, score, strict=True) for q in range(2)]
        lists.add(pa.array(ids), retrieval.np.array(score), 0, 0.0, 6)
        assert lists.held <= 20 + 16
    (got,) = lists.batches(["q", "id", "score"])
    assert sorted(zip(*(c.to_pylist() for c in got.columns[:2]), strict=True)) == sorted((q, i) for want in (0, 1) for q, _, i in sorted(r for r in rows if r[0] == want)[:3])


def test_many_queries_take_few_scans(spark):
    """2,000 queries with words of their own are answered by one scan, as by SQL."""
    q = spark.range(2000).select(F.col("id").alias("query_id"), F.concat(F.lit("the own"), "id", F.lit(" and")).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the own"), (F.col("id") * 7).cast("string"), F.when(F.col("id") % 3 == 0, " and").otherwise(" or")).alias("text"))
    got = retrieval.bm25(q, docs, 2)
    assert got._jdf.queryExecution().toString().count("MapInArrow") <= 8  # four plans of one scan; some hundred scans before
    best = {r["query_id"]: r["doc_id"] for r in got.filter("rank = 1").collect()}
    assert len(best) == 2000 and all(best[7 * i] == i for i in range(0, 286)) and best[1] == 0


def test_terms_within_words():
    terms = ["a", "bc", "ü", "abcd", "x\ny"]
    held = retrieval._Held({t: i for i, t in enumerate(terms)}, most=2)
    for text in ("", "abcd", "zbc ü", "x\ny", "  a  ", "ab cd", "x\nybc" * 30):
        assert held.by(text) == [i for i, t in enumerate(terms) if t in text]


def test_embedder_keeps_no_long_words():
    """Memory of an embedder does not grow with the words of the texts; the vectors are those of each word's digest."""
    embed = chunking.hashing_embedder(64, unit=False)
    words = ["Ab\u00a0c", "İx", "\x1cy", "a" * 65, "ab", "ab"]
    want = np.zeros(64)
    for w in words:
        h = hashlib.md5(w.lower().encode(), usedforsecurity=False).digest()
        want[h[0] % 64] += 1 if h[1] >> 7 else -1
    assert embed([" \t".join(words) + "\n", ""]).tolist() == [want.tolist(), [0] * 64]
    tracemalloc.start()
    for i in range(300):
        embed([f"{i}" + "z" * 100_000])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2_000_000  # 30 MB where every word was remembered
    codes = chunking._Codes(most=10)
    assert [codes[str(i % 15).encode()] for i in range(60)] == [chunking._Codes()[str(i % 15).encode()] for i in range(60)] and len(codes) <= 10


def test_arrow_batches_of_long_texts(spark):
    """Texts of 1 MB come in batches of some MB, to functions of batches and of columns."""
    base.texts(spark, SF, "documents")
    docs = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def task(bs):
        for b in bs:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    @F.arrow_udf("long")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int64())

    assert docs.mapInArrow(task, "n long").agg(F.max("n")).head()[0] <= 10
    assert docs.select(rows("text").alias("n")).agg(F.max("n")).head()[0] <= 10


def test_terms_are_cut_at_ascii_blanks_and_stops():
    text = "The, own\x1cTERM. İx!\x0b\x0c a b?:;\r\nÜ \x85z\x00 "
    assert [w.decode() for w in retrieval._terms(text)] == re.findall(r"[^ \t\n\x0b\f\r.,;:!?]+", text.lower())
    assert retrieval._terms(None) == []
