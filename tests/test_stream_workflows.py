"""Approvals and forks as streams, against their batch queries."""

import pytest
from pyspark.sql import functions as F

from meshlark.operators import decisions, workflow
from meshlark.streaming import approvals, folds, forks

SF = "/root/testdata/sf0.001/events.parquet"
LEVELS = [("lead", 21_600.0), ("manager", 86_400.0)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    approvals.use_state(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def write(df, path, mode="append"):
    df.coalesce(1).write.mode(mode).parquet(path)


def asked(e):
    kind = F.when(F.col("event_type") == "view", "asked").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("other")
    return e.select(F.col("user_id").alias("request"), "ts", kind.alias("kind"))


def test_approvals_end_like_the_batch(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    e = asked(spark.read.parquet(SF)).filter("request < 60")
    now = e.agg(F.max("ts")).head()[0]
    halves = e.agg(F.expr("percentile_approx(unix_micros(ts::timestamp), 0.5)")).head()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= halves
    write(e.filter(early), path)
    write(e.filter(~early), path)
    clock = spark.createDataFrame([(-1, "approved")], "request long, kind string").withColumn("ts", F.lit(now)).select("request", "ts", "kind")
    for _ in range(2):  # the watermark moves after a batch, timers fire in the next
        write(clock, path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    told = folds.run_to_end(approvals.approval_stream(stream, LEVELS, keep_s=4000 * 86_400.0), "approvals", str(tmp_path / "c"), "append").collect()
    last = {}
    for r in sorted(told, key=lambda r: r["n"]):
        last[r["request"]] = (r["level"], r["outcome"])
    requests = e.filter("kind = 'asked'").groupBy("request").agg(F.min("ts").alias("asked_at"))
    answers = e.filter("kind IN ('approved', 'rejected')").select("request", F.col("ts").alias("answered_at"), (F.col("kind") == "approved").alias("approved"))
    want = {r["request"]: (r["level"], r["outcome"]) for r in decisions.approval_outcomes(requests, answers, LEVELS, F.lit(now).cast("timestamp_ntz")).collect()}
    assert last == want and len({o for _, o in want.values()}) >= 3
    assert len(told) == len({(r["request"], r["n"]) for r in told})


def test_a_request_goes_from_level_to_level_and_is_forgotten(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    rows = [[(1, 0, "asked"), (2, 0, "rejected")], [(9, 3, "asked")], [(1, 3, "other"), (2, 2, "asked"), (9, 4, "other")], [(9, 9, "approved")], [(9, 12, "other"), (9, 12, "approved")], [(9, 40, "approved")], [(9, 41, "approved")], [(1, 42, "approved")]]
    made = None
    for batch in rows:
        df = spark.createDataFrame(batch, "request long, h int, kind string").selectExpr("request", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "kind")
        write(df, path)
        made = df.schema
    stream = spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(path)
    told = folds.run_to_end(approvals.approval_stream(stream, [("lead", 3600.0), ("manager", 3 * 3600.0)], keep_s=3600.0), "levels", str(tmp_path / "c"), "append").collect()
    of = lambda k: [(r["level"], r["outcome"]) for r in sorted(told, key=lambda r: r["n"]) if r["request"] == k]
    assert of(1) == [("lead", "waiting"), ("manager", "waiting"), (None, "expired")]  # the answer after that is of no known request
    assert of(2)[:1] == [("lead", "waiting")] and of(2)[-1] == (None, "expired")  # an answer before the request does not count


def test_forks_end_like_the_batch(spark, tmp_path):
    e, path = spark.read.parquet(SF), str(tmp_path / "in")
    k = F.col("event_type")
    status = F.when(k == "error", "Failed").when(k == "click", "FailedWithRecovery").when(k == "signup", "Running").otherwise("Success")
    rows = e.select(F.floor(F.col("event_id") / 3).alias("fork_id"), (F.col("event_id") % 3).cast("int").alias("path"), status.alias("status"), "ts").filter("NOT (fork_id = 5 AND path = 1)")
    rows.repartition(3).write.parquet(path)
    for days in (9000, 18_000):
        late = rows.limit(1).withColumns({"fork_id": F.lit(-1).cast("long"), "path": F.lit(0), "ts": F.col("ts") + F.make_dt_interval(F.lit(days))})
        write(late.unionByName(late.withColumn("path", F.lit(1))).unionByName(late.withColumn("path", F.lit(2))), path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    got = folds.run_to_end(forks.fork_joins(stream, 3, "3650 days", "3650 days"), "forks", str(tmp_path / "c"), "append").filter("fork_id >= 0")
    want = workflow.fork_status(rows, ["fork_id"], 3)
    key = lambda df: sorted((r["fork_id"], r["ready"], r["all_succeeded"], r["any_failed"], r["any_recovered"]) for r in df.collect())
    assert key(got) == key(want) and got.filter("fork_id = 5 AND NOT ready").count() == 1
