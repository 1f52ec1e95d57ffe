"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.operators import retrieval, vector_index

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 24))
    rows = [(i, v, i % 40, "x" if i % 3 else "y") for i, v in enumerate(x.tolist())] + [(9001, None, 1, "x"), (9002, [1.0], 1, "x"), (9003, [], 1, "x")]
    return spark.createDataFrame(rows, "item_id long, vector array<double>, part int, kind string").cache()


@pytest.fixture(scope="module")
def built(vectors, tmp_path_factory):
    made = {}
    for metric in ("cosine", "l2", "inner_product"):
        folder = str(tmp_path_factory.mktemp(metric))
        vector_index.build(vectors, folder, 24, metric, columns=("part", "kind"))
        made[metric] = vector_index.load(vectors.sparkSession, folder)
    return made


def lists(df, item="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r[item], round(r["score"], 5)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def asked(vectors):
    return vectors.filter("item_id % 60 = 0").select(F.col("item_id").alias("query_id"), "vector")


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_recall_and_exactness(vectors, built, metric):
    want = lists(retrieval.nearest(asked(vectors), vectors.filter("item_id < 9000"), 10, metric), "item_id")
    got = lists(vector_index.search(built[metric], asked(vectors), 10, probes=6))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert len(got) == 50 and hits / 500 >= 0.9
    every = lists(vector_index.search(built[metric], asked(vectors), 10, probes=24))
    assert [[i for i, _ in every[q]] for q in sorted(want)] == [[i for i, _ in want[q]] for q in sorted(want)]


def test_filtered_scans(vectors, built):
    """A narrow filter: one round leaves lists short; iterated ones are full, strict ones in order of score."""
    queries, where = asked(vectors), (F.col("part") == 7) & (F.col("kind") == "x")
    passing = {r["item_id"] for r in vectors.filter(where).collect()}
    off, relaxed, strict = (lists(vector_index.search(built["cosine"], queries, 12, where, mode, probes=2)) for mode in (vector_index.OFF, vector_index.RELAXED, vector_index.STRICT))
    assert min(len(off.get(q, [])) for q in strict) < 12
    for got in (relaxed, strict):
        assert all(len(v) == 12 and {i for i, _ in v} <= passing for v in got.values()) and len(got) == 50
    assert all([s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in strict.values())
    exact = lists(retrieval.nearest(queries, vectors.filter(where), 12), "item_id")
    every = lists(vector_index.search(built["cosine"], queries, 12, where, vector_index.STRICT, probes=24))
    assert {q: [i for i, _ in v] for q, v in every.items()} == {q: [i for i, _ in v] for q, v in exact.items()}


def test_all_rows_when_fewer_pass(vectors, built):
    got = lists(vector_index.search(built["cosine"], asked(vectors), 500, F.col("part") == 3, vector_index.STRICT, probes=1))
    assert all(len(v) == vectors.filter("part = 3 AND item_id < 9000").count() for v in got.values())


def test_queries_without_a_place(spark, built):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None] * 24)], "query_id long, vector array<double>")
    assert vector_index.search(built["l2"], odd, 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.search(built["l2"], odd, 0)


def test_only_visited_cells_are_read(vectors, built):
    one = asked(vectors).limit(1)
    plan = vector_index.search(built["cosine"], one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters", 1)[1][:80]


def test_recall_on_the_table(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(items, str(tmp_path / "i"), 8)
    queries = items.filter("item_id % 25 = 0").select(F.col("item_id").alias("query_id"), "vector")
    got, want = lists(vector_index.search(index, queries, 10, probes=7)), lists(retrieval.nearest(queries, items, 10), "item_id")
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want)) >= 0.9
