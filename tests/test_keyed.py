"""Tables with a key: repeated, broken and racing writes."""

import threading

import pytest
from pyspark.sql import functions as F

from meshlark.sources import keyed


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, part string, v string, n int").schema
    return keyed.KeyedTable(spark, str(tmp_path / "t"), schema, ["k", "part"], buckets=4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, part string, v string, n int")


def content(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_rules_for_keys_that_are_there(spark, table):
    assert content(table) == [] and table.version() == 0
    assert table.upsert(frame(spark, [(1, "a", "x", 1), (1, "a", "y", 2), (2, "a", "z", 1)])) == 1
    assert content(table) == [(1, "a", "y", 2), (2, "a", "z", 1)]
    table.upsert(frame(spark, [(1, "a", "new", 0), (3, "b", "w", 1)]))
    assert content(table) == [(1, "a", "new", 0), (2, "a", "z", 1), (3, "b", "w", 1)]
    table.upsert(frame(spark, [(1, "a", "no", 9), (4, "b", "q", 1)]), on_conflict=keyed.KEEP)
    assert content(table) == [(1, "a", "new", 0), (2, "a", "z", 1), (3, "b", "w", 1), (4, "b", "q", 1)]
    with pytest.raises(keyed.KeyConflict):
        table.upsert(frame(spark, [(9, "a", "u", 1), (2, "a", "t", 1)]), on_conflict=keyed.FAIL)
    with pytest.raises(ValueError):
        table.upsert(frame(spark, [(None, "a", "u", 1)]))
    assert len(content(table)) == 4 and content(table, 1) == [(1, "a", "y", 2), (2, "a", "z", 1)]
    assert [tuple(r) for r in table.get(k=3, part="b").collect()] == [(3, "b", "w", 1)] and table.get(k=8, part="b").count() == 0


def test_a_batch_counts_once(spark, table):
    rows = frame(spark, [(i, "p", str(i), i) for i in range(50)])
    assert table.upsert(rows, batch="b1") == 1
    table.upsert(frame(spark, [(3, "p", "later", 0)]), batch="b2")
    assert table.upsert(rows, batch="b1") == 2  # a repeated job does not undo what came after it
    assert len(content(table)) == 50 and (3, "p", "later", 0) in content(table)


def test_a_write_that_broke_off_leaves_no_trace(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, "a", "x", 1)]), batch="one")

    def broken(self, version, manifest):
        raise OSError("gone between stage and commit")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", broken)
        with pytest.raises(OSError):
            table.upsert(frame(spark, [(1, "a", "half", 2), (2, "a", "half", 2)]), batch="two")
    assert content(table) == [(1, "a", "x", 1)]
    table.upsert(frame(spark, [(1, "a", "whole", 2), (2, "a", "whole", 2)]), batch="two")
    assert content(table) == [(1, "a", "whole", 2), (2, "a", "whole", 2)]
    assert table.vacuum() >= 1 and content(table) == [(1, "a", "whole", 2), (2, "a", "whole", 2)]


def test_a_claim_of_a_dead_writer(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, "a", "x", 1)]))
    fs, claim = table._fs(f"{table.path}/claims/{2:012d}")
    fs.create(claim, False).close()
    monkeypatch.setattr(keyed.KeyedTable, "_wait_for", lambda self, version, real=keyed.KeyedTable._wait_for: real(self, version, 0.1))
    with pytest.raises(keyed.Raced):
        table.upsert(frame(spark, [(2, "a", "y", 1)]))
    assert content(table) == [(1, "a", "x", 1)]
    table.release(1)  # a committed version stays
    table.release(2)
    assert table.upsert(frame(spark, [(2, "a", "y", 1)])) == 2 and len(content(table)) == 2


def test_two_writers_lose_nothing(spark, table):
    failed = []

    def write(part):
        try:
            for i in range(2):
                table.upsert(frame(spark, [(k, part, f"{part}{i}", i) for k in range(i, i + 5)]), batch=f"{part}{i}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(p,)) for p in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table.version() == 4
    assert table.read().groupBy("part").agg(F.count("*").alias("n")).filter("n = 6").count() == 2
    assert {tuple(r) for r in table.read().select("k", "v").filter("part = 'x'").collect()} == {(0, "x0"), *((k, "x1") for k in range(1, 6))}
