"""The data source through Arrow, in batches and streams."""

import pytest
from pyspark.sql import functions as F

from meshlark.sources import arrow_files
from meshlark.sources.tables import query_events
from meshlark.streaming import folds

SF = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def source(spark):
    arrow_files.register(spark)
    return spark.read.format("arrow_files")


def plain(df):
    return sorted(map(str, df.collect()))


def test_rows_and_filters_are_those_of_the_plain_reader(spark, source, tmp_path):
    e = spark.read.parquet(SF)
    e.repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "parts"))
    got = source.load(str(tmp_path / "parts"))
    assert got.schema == e.schema and plain(got) == plain(e)
    some = query_events(got, object_id="5", kinds=["view", "click"], id_col="user_id")
    assert plain(some) == plain(query_events(e, object_id="5", kinds=["view", "click"], id_col="user_id"))
    cut = (F.col("event_id") >= 10) & (F.col("event_id") < 40) & F.col("event_type").isin("view", "error")
    assert plain(got.filter(cut)) == plain(e.filter(cut)) and plain(got.filter(F.length("event_type") > 4).select("event_id")) == plain(e.filter(F.length("event_type") > 4).select("event_id"))


def test_filters_leave_the_plan_and_prune_row_groups(spark, source, tmp_path):
    spark.read.parquet(SF).repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "parts"))
    got = source.load(str(tmp_path / "parts"))
    assert got.rdd.getNumPartitions() == 4 and got.filter("event_id = 7").rdd.getNumPartitions() == 1
    plan = got.filter("event_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")  # nothing is left to Spark
    assert got.filter("event_id = -1").count() == 0


def test_a_stream_reads_each_file_once(spark, source, tmp_path):
    e, path = spark.read.parquet(SF), tmp_path / "in"
    e.filter("event_id < 100").coalesce(1).write.parquet(str(tmp_path / "a"))
    e.filter("event_id >= 100").coalesce(1).write.parquet(str(tmp_path / "b"))
    path.mkdir()
    next((tmp_path / "a").glob("*.parquet")).rename(path / "000.parquet")
    stream = spark.readStream.format("arrow_files").load(str(path))
    assert folds.run_to_end(stream, "arrow_one", str(tmp_path / "c"), "append").count() == e.filter("event_id < 100").count()
    next((tmp_path / "b").glob("*.parquet")).rename(path / "001.parquet")
    again = spark.readStream.format("arrow_files").load(str(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True)
    for _ in range(2):
        again.start().awaitTermination()
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(e)
