"""Walks to any depth, and pairs of intervals that clash, against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import DataFrameWriter

from meshlark.operators import reach, temporal


def plain_depths(start, edges):
    out, todo = {s: 0 for s in start}, deque(start)
    while todo:
        at = todo.popleft()
        for a, b in edges:
            if a == at and b not in out:
                out[b] = out[at] + 1
                todo.append(b)
    return out


def edge_frame(spark, edges):
    return spark.createDataFrame([(*a, *b) for a, b in edges], "src_type string, src_id string, tgt_type string, tgt_id string")


@pytest.mark.parametrize("seed", [1, 2])
def test_least_depths_in_a_graph_with_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = [(t, str(i)) for t in "ab" for i in range(15)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(35)] + [(nodes[0], nodes[0])]
    start = [nodes[0], nodes[3]]
    frame = edge_frame(spark, edges + edges[:5])
    got = {(r["type"], r["id"]): r["depth"] for r in reach.reachable(spark.createDataFrame(start + [start[0], (None, "9")], "type string, id string"), [frame]).collect()}
    assert got == plain_depths(start, edges)
    two = {(r["type"], r["id"]): r["depth"] for r in reach.reachable(spark.createDataFrame(start, "type string, id string"), [frame], max_depth=2).collect()}
    assert two == {n: d for n, d in plain_depths(start, edges).items() if d <= 2}


def test_walk_without_edges_or_start(spark):
    start, none = spark.createDataFrame([("a", "1")], "type string, id string"), spark.createDataFrame([], "src_type string, src_id string, tgt_type string, tgt_id string")
    assert [tuple(r) for r in reach.reachable(start, [none]).collect()] == [("a", "1", 0)]
    assert reach.reachable(start.limit(0), [edge_frame(spark, [(("a", "1"), ("b", "2"))])]).count() == 0
    with pytest.raises(ValueError):
        reach.reachable(start, [none], max_depth=-1)


def test_a_round_does_not_deal_the_edges_again(spark, monkeypatch):
    """Edges are read from the tables once and dealt once; a round's plan scans what is held, for its own types."""
    rows = [(("a", str(i)), ("b", str(i % 40))) for i in range(200)] + [(("b", str(i)), ("c", "1")) for i in range(40)]
    plans, write = [], DataFrameWriter.parquet

    def noted(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large frontiers
    try:
        got = reach.reachable(spark.createDataFrame([("a", str(i)) for i in range(100)], "type string, id string"), [edge_frame(spark, rows)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["depth"], r["count"]) for r in got.groupBy("depth").count().collect()) == [(0, 100), (1, 40), (2, 1)]
    assert len(plans) == 4  # the start, two rounds that find something, and one that does not
    for plan in plans[1:]:
        above, held = plan.split("InMemoryRelation", 1)
        assert "Exchange hashpartitioning(src_type" not in above and "InMemoryTableScan" in above and "REPARTITION_BY_NUM" in held
        assert "(src_type" in above.rsplit("InMemoryTableScan", 1)[1]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_conflicts_equal_all_pairs(spark, seed):
    """Lengths from seconds to years, open, empty and inverted intervals, equal beginnings, repeated ids and null keys."""
    rng, rows = random.Random(seed), []
    for i in range(150):
        begin = rng.choice([0, 3600, 86_400]) * rng.randrange(400)
        length = rng.choice([None, -5, 0, 1, 1800, 3600, 7200, 86_400, 40 * 86_400, 900 * 86_400])
        rows.append((rng.choice([1, 1, 1, 2, None]), i if i % 50 else 0, None if i % 41 == 40 else begin, None if length is None else begin + length))
    frame = spark.createDataFrame(rows, "k int, id int, f long, t long").selectExpr("k", "id", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, f) AS valid_from", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS valid_to")
    got = sorted((r["k"], r["first_id"], r["second_id"]) for r in temporal.conflicts(frame, ["k"], "id").collect())
    fine = [r for r in rows if r[0] is not None and r[2] is not None and (r[3] is None or r[3] > r[2])]
    end = lambda r: float("inf") if r[3] is None else r[3]
    want = sorted((a[0], a[1], b[1]) for a in fine for b in fine if a[0] == b[0] and a[1] != b[1] and a[2] <= b[2] < end(a) and (b[2] > a[2] or b[1] > a[1]))
    assert got == want and len(want) > 300
    assert temporal.conflicts(frame.limit(0), ["k"], "id").count() == 0
