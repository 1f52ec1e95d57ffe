from meshlark.streaming import folds

SF = "/root/testdata/sf0.001/events.parquet"


def parts(spark, tmp_path):
    e = spark.read.parquet(SF)
    path = str(tmp_path / "in")
    e.repartition(5, "event_id").write.parquet(path)  # out of order, in several files
    return e, folds.event_stream(spark, path, e.schema)


def test_running_fold_ends_like_the_batch(spark, tmp_path):
    e, stream = parts(spark, tmp_path)
    seen = folds.run_to_end(folds.running_beliefs(stream), "beliefs", str(tmp_path / "c"))
    last = {r["user_id"]: tuple(r) for r in seen.orderBy("events").collect()}
    assert last == {r["user_id"]: tuple(r) for r in folds.batch_beliefs(e).collect()}


def test_windows_in_complete_mode(spark, tmp_path):
    e, stream = parts(spark, tmp_path)
    got = folds.run_to_end(folds.windowed_counts(stream, "1 day", "3650 days"), "windows", str(tmp_path / "c"), "complete")
    assert sorted((str(r["start"])[:10], r["event_type"], r["n"]) for r in got.collect()) == sorted((str(r["start"])[:10], r["event_type"], r["n"]) for r in folds.windowed_counts(e, "1 day").collect())


def test_events_once(spark, tmp_path):
    e = spark.read.parquet(SF)
    path = str(tmp_path / "twice")
    e.unionByName(e).repartition(3).write.parquet(path)
    got = folds.run_to_end(folds.once(folds.event_stream(spark, path, e.schema, 10), ["event_id"], "3650 days"), "once", str(tmp_path / "c"), "append")
    assert got.count() == e.count()


def test_phase_timers_end_like_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from meshlark.operators import workflow

    e = spark.read.parquet(SF).filter("user_id < 40")
    path, limit = str(tmp_path / "in"), 3 * 86_400
    # All events in one file, then one that moves the watermark past every deadline, then one to let the timers fire.
    e.coalesce(1).write.parquet(path)
    for days in (3650, 7300):
        late = e.limit(1).withColumns({"user_id": F.lit(-days).cast("long"), "event_id": F.lit(-1).cast("long"), "ts": F.col("ts") + F.make_dt_interval(F.lit(days))})
        late.coalesce(1).write.mode("append").parquet(path)
    got = folds.run_to_end(folds.phase_timers(folds.event_stream(spark, path, e.schema), limit), "timers", str(tmp_path / "c"), "append")
    mine = {r["event_id"]: r["timed_out"] for r in got.filter("workflow_id >= 0").collect()}
    now = F.lit("2200-01-01").cast("timestamp_ntz")
    want = workflow.timeouts(e.withColumnRenamed("user_id", "workflow_id"), "workflow_id", ["ts", "event_id"], "ts", F.lit(limit), now)
    assert mine == {r["event_id"]: r["timed_out"] for r in want.collect()}


def test_a_model_follows_its_edits(spark, tmp_path):
    import json

    path = tmp_path / "edits"
    path.mkdir()
    for i in range(3):
        (path / f"{i}.json").write_text(json.dumps({"position": i, "op": "remove_property", "domain": "d", "type": "t", "body": f"p{i}"}))
    got = folds.run_to_end(folds.changes(spark, str(path)), "edits", str(tmp_path / "c"), "append")
    assert [r["body"] for r in got.orderBy("position").collect()] == ["p0", "p1", "p2"]
