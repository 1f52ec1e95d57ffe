"""Many keyword queries at a time: lists equal those of plain sums, and queries that ask the same are answered once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlark.operators import keyword_tiles, retrieval


@pytest.mark.parametrize(("size", "share", "often", "asked"), [(64, 0.05, 4, 6), (512, 1.0, 0, 6), (200, 0.0, 2, 3), (64, 0.05, 4, 40_000)])
def test_lists_equal_plain_sums(monkeypatch, size, share, often, asked):
    """Rows, cells and bounds of any kind leave out nothing; ties stay; terms no document has do no harm."""
    monkeypatch.setattr(keyword_tiles, "SHARE", share)
    monkeypatch.setattr(keyword_tiles, "FREQUENT", often)
    monkeypatch.setattr(keyword_tiles, "TILE", 16)
    rng, n, words, top = np.random.default_rng(3), 600, 80, 4
    chance = 1 / np.arange(1, words + 1)
    docs = [np.sort(rng.choice(words - 2, rng.integers(0, 30), replace=False, p=chance[:-2] / chance[:-2].sum())) for _ in range(n)]
    docs[300:340] = docs[:40]  # copies
    weight = [np.round(rng.random(len(d)) * 4 / chance[d] ** 0.3, 3) for d in docs]
    weight[300:340] = weight[:40]
    sets = [np.sort(rng.choice(words, rng.integers(1, 9), replace=False)) for _ in range(50)] + [np.array([words - 1]), np.array([0])]
    if asked > words:  # one query of very many terms: its sums need wider integers
        sets.append(np.arange(asked))
    df = np.bincount(np.concatenate(docs), minlength=max(words, asked)).astype(float)
    asking = keyword_tiles.Asking(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), df, n, top)
    best, got = asking.lists(), retrieval._Lists(len(sets), top)
    for at in range(0, n, size):
        part = docs[at : at + size]
        rows = np.repeat(np.arange(len(part)), [len(d) for d in part])
        for q, d, score in asking.found(best, len(part), rows, np.concatenate(part), np.concatenate(weight[at : at + size])):
            got.put(q, pa.array(d + at), score)
    found = {}
    for b in got.batches(["q", "doc", "score"]):
        for q, d, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(q, []).append((-score, d))
    for q, terms in enumerate(sets):
        sums = [(-round(float(w[np.isin(d, terms)].sum()), 6), i) for i, (d, w) in enumerate(zip(docs, weight, strict=True)) if np.isin(d, terms).any()]
        want = sorted(sums)[:top]
        assert [d for _, d in sorted(found.get(q, []))] == [d for _, d in want], q
        assert np.allclose([s for s, _ in sorted(found.get(q, []))], [s for s, _ in want], atol=1e-6)


def test_blocks_of_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, at + 7)), pa.array([[1, 2]] * 7)], names=["i", "l"]) for at in range(0, 70, 7)]
    got = [b.column(0).to_pylist() for b in keyword_tiles.blocks(batches, 16, 1)]
    assert sum(got, []) == list(range(70)) and [len(x) for x in got] == [2, 16, 16, 16, 16, 4]


def test_queries_with_the_same_terms_are_one(spark):
    """40,000 queries with three sets of terms take one scan; before, a scan for each 16,384 queries."""
    q = spark.range(40_000).select("id", F.element_at(F.array(*map(F.lit, ("Red green", "green, red red", "blue", "?!", "grey"))), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    docs = spark.createDataFrame([(1, "red red green"), (2, None), (3, "blue blue"), (4, "green blue, green.")], "doc_id long, text string")
    got = retrieval.bm25(q, docs, 1, query_id="id")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in got.groupBy(F.col("id") % 5, "doc_id", "rank").count().collect()) == [(0, 1, 1, 8000), (1, 1, 1, 8000), (2, 3, 1, 8000)]
    few = {r["id"]: r["score"] for r in retrieval.bm25(q.filter("id < 5"), docs, 1, query_id="id").collect()}
    assert {r["id"] % 5: r["score"] for r in got.filter("id > 39000").collect()} == few
