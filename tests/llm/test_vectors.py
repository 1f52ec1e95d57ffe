"""Nearest neighbours, hard negatives and clusters against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.llm import centroids, hard_negatives, hash_forest, queries

from ..oracle import connect, same

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, `query` string, `class` int, `part` string, `key` int, `grp` string, `rank` string, `score` string, `id` int, `cluster` string, `vector` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "q", 1, "p", 2, "g", "r", "s", 3, "c", 4) for r in rows], SCHEMA)


def odd_rows(dims=8, copies=60):
    """Ties, copies, a hot vector, repeated rows and ids, other lengths, and rows that take no part."""
    rng = np.random.default_rng(5)
    f32 = lambda x: [float(v) for v in np.float32(x)]
    rows = [(i, f32(rng.normal(size=dims) * (1 + i % 3)), i % 4) for i in range(1, 160)]
    rows += [(i, f32(np.ones(dims)), 1) for i in range(200, 200 + copies)] + [(1000 - i, f32(np.eye(dims)[i % dims]), i % 3) for i in range(40)]
    rows += [rows[3], rows[3], (5, f32(np.full(dims, 2.0)), 0), (280, f32(np.ones(3)), 2), (281, [], 2)]
    rows += [(300, None, 1), (320, [1.0] * (dims - 1) + [None], 1), (340, [math.nan] * dims, 1), (360, [math.inf] + [0.0] * (dims - 1), 1), (380, [0.0] * dims, 1), (None, f32(np.ones(dims)), 1), (400, f32(np.ones(dims)), None)]
    return rows


def used(rows, zero=True, label=False):
    """id -> (label, vector) of the rows that take part; of one id the least row."""
    out = {}
    for i, v, c in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (label and c is None) or (not zero and not any(v)):
            continue
        key = (c, v) if label else (v,)
        if i not in out or key < out[i][0]:
            out[i] = (key, c, v)
    return {i: (c, v) for i, (_, c, v) in out.items()}


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


# -- nearest neighbours -------------------------------------------------------------------


def nearest(rows, k, every):
    have = used(rows, zero=False)
    return {q: sorted(((-dot(v, w), i) for i, (_, w) in have.items() if i != q))[:k] for q, (_, v) in have.items() if q % every == 0}


@pytest.mark.parametrize("setting", [{}, {"beside": 2, "part_rows": 16, "miss": 1e-12, "trees": 8}])
def test_nearest_is_exact_where_nothing_may_be_missed(spark, setting):
    """With a tiny chance to miss, or few rows, every neighbour is found; small parts cut hot strings."""
    rows = odd_rows()
    got = {}
    for r in hash_forest.nearest_neighbours(table(spark, rows), F.col("vec_id") % 5 == 0, k=7, **setting).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = nearest(rows, 7, 5)
    assert {q: [(n + 1, *x) for n, x in enumerate(w)] for q, w in want.items()} == {q: sorted(g) for q, g in got.items()}


def test_nearest_returns_all_of_a_small_table_and_none_of_an_empty_one(spark):
    small = table(spark, [(20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (40, [-1.0, 0.0], 2)])
    found = hash_forest.nearest_neighbours(small, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(20, 1, 0.5), (20, 40, -1.0), (40, 1, -0.5), (40, 20, -1.0)]
    assert hash_forest.nearest_neighbours(small.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hash_forest.nearest_neighbours(small, F.col("vec_id") > 99).count() == 0


def test_nearest_recall_on_scattered_and_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x[3000:] = x[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 32))
    x[:, :] *= np.exp(0.2 * rng.normal(size=(6000, 1)))  # other norms
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in hash_forest.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, part_rows=2048).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hits / 6000 >= 0.9


def test_nearest_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in queries.op11_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["score"] == dot(x[ids == r["query_id"]][0].tolist(), x[ids == r["vec_id"]][0].tolist())
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        best = ids[np.lexsort((ids, -s))][: min(20, len(ids) - 1)]
        hits, total = hits + len(set(best.tolist()) & {v for v, _ in got[ids[at]]}), total + len(best)
    assert hits / total >= 0.9


def test_levels_keep_the_chance_to_miss(spark):
    cos = [-1.0, -0.3, 0.0, 0.2, 0.5, 0.9, 0.999, 1.0]
    rows = spark.createDataFrame([(c,) for c in cos], "c double").select("c", hash_forest.levels(F.col("c"), 16, 0.1).alias("x")).collect()
    for r in rows:
        p = 1 - math.acos(r["c"]) / math.pi
        assert (1 - p ** r["x"]) ** 16 <= 0.1 + 1e-9 and (r["x"] == hash_forest.BITS or (1 - p ** (r["x"] + 1)) ** 16 > 0.1)


# -- hard negatives -----------------------------------------------------------------------


def negatives(rows, every, scale=256):
    have = used(rows, label=True)
    q = {i: [max(min(math.floor(scale * x), 2**26), -(2**26)) for x in v] for i, (_, v) in have.items()}
    out = []
    for a in have:
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(q[a], q[i])), i) for i in have if i != a)
        for p, i in [(-x, i) for x, i in s if have[i][0] == have[a][0]][:5]:
            fit = [(-x, j) for x, j in s if have[j][0] != have[a][0] and 50 * p <= -100 * x <= 95 * p][:3]
            out += [(a, i, n + 1, j, p, x) for n, (x, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(512, 2048, 32, 1 << 36), (3, 7, 3, 1)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, sizes):
    """Also with tiny tiles, several chunks and a wave for each anchor panel."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[0])
    monkeypatch.setattr(hard_negatives, "ROWS", sizes[1])
    rows = odd_rows()
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, chunk=sizes[2], wave=sizes[3]).collect()
    want = negatives(rows, 5)
    assert len(want) > 100 and sorted(tuple(r) for r in got) == want


def test_hard_negatives_send_no_scores(spark):
    """What is shuffled is in proportion to the table, not to anchors times rows (32 MB of scores here)."""
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    x = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v, i % 4) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    before = sent()
    assert hard_negatives.hard_negatives(rows, F.col("vec_id") % 4 == 0).count() > 0
    assert sent() - before < 12_000_000


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(i, [3e38 * (-1) ** (i // 3), float(i), 1e6], i % 2) for i in range(30)]
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0).collect()) == negatives(rows, 5)
    assert hard_negatives.hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(table(spark, [(5, None, 1)]), F.col("vec_id") % 5 == 0).count() == 0


# -- clusters -----------------------------------------------------------------------------


def clustered(rows, dims, k, rounds, scale=64):
    keep = [(i, [max(min(math.floor(scale * x), 2**26), -(2**26)) for x in v], v) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, q) for i, q, v in keep if i is not None)[:k]
    cents = [q for _, _, q in start]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((off(q, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(q)[1] for _, q, _ in keep]
        cents = [[sum(col) // of.count(n) for col in zip(*(q for (_, q, _), o in zip(keep, of) if o == n))] if n in of else c for n, c in enumerate(cents)]
    return sorted([(i is None, i, near(q)[1], near(q)[0]) for i, q, _ in keep], key=str), cents


def test_clusters_equal_plain_integers(spark):
    rows = odd_rows()
    assigned, cents = centroids.cluster_vectors(table(spark, rows), dims=8, k=9, rounds=3)
    want, plain = clustered(rows, 8, 9, 3)
    assert sorted([(r[0] is None, *r) for r in assigned.collect()], key=str) == want and cents.tolist() == plain
    total = sum(w[3] for w in want)
    for r in centroids.with_inertia(assigned, cents).collect():
        assert r["inertia"] == total and r["cluster_inertia"] == sum(w[3] for w in want if w[2] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, plain[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_few_huge_or_no_vectors(spark):
    rows = [(i, [3e38, -3e38, float(i)], 0) for i in range(5)]
    assigned, cents = centroids.cluster_vectors(table(spark, rows), dims=3)
    assert sorted([(False, *r) for r in assigned.collect()], key=str) == clustered(rows, 3, 16, 3)[0]
    none = centroids.with_inertia(*centroids.cluster_vectors(table(spark, rows).limit(0), dims=3))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nearest_centroid_is_exact_where_single_precision_is_not():
    rng = np.random.default_rng(1)
    cents = rng.integers(-(2**25), 2**25, (6, 64))
    points = np.concatenate([cents + rng.integers(-1, 2, (6, 64)), (cents[:3] + cents[3:]) // 2 + rng.integers(-1, 2, (3, 64)), np.zeros((1, 64), dtype=np.int64)])
    cents = np.concatenate([cents, cents[:2], cents[:1] + 1])  # equal ones, and one a step away
    got, off = centroids.nearest(points, cents)
    plain = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)), n) for n, c in enumerate(cents)) for p in points]
    assert [(int(d), int(c)) for d, c in zip(off, got)] == plain


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_centroids"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    from meshlark.llm import oracle

    rows = [(i, (v * 8)[:64] if v and len(v) == 8 else v, c) for i, v, c in odd_rows()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "made"))
    (made,) = (tmp_path / "made").glob("*.parquet")
    made.rename(tmp_path / "embeddings.parquet")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    same(queries.queries()[name](spark, str(tmp_path)), con, oracle.oracle_sql()[name])
