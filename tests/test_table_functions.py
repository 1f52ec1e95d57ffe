"""Table functions and counted plans."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meshlark.functions import table_functions
from meshlark.operators import observed
from meshlark.plans.domain import graph

SF = "/root/testdata/sf0.001"


def test_chunk_text_checks_its_arguments(spark):
    table_functions.register(spark)
    assert spark.sql("SELECT * FROM chunk_text('One. Two three.', 'whole', 10, 0)").collect()[0]["content"] == "One. Two three."
    assert spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING)), ('') AS t(x), LATERAL chunk_text(x, 'fixed', 10, 0)").count() == 0
    for call in ("chunk_text('a', 'nothing', 10, 0)", "chunk_text('a', 'fixed', 0, 0)", "chunk_text('a', 'fixed', 10, 10)", "chunk_text(1, 'fixed', 10, 0)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_steps_check_their_columns(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("no_times")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM steps(TABLE(no_times), 'k', 'step', 'ts')").collect()


def test_a_walk_is_counted_by_its_own_job(spark):
    start = graph(spark, SF).objects("region").where(F.col("r_regionkey") < 3)
    end, trace = observed.observed_walk(start, ["nations", "customers"])
    assert trace.seconds is None
    trace.run(end.df)
    plain = start.traverse("nations").count(), start.traverse("nations").traverse("customers").count()
    assert {k: v["rows"] for k, v in trace.values().items()} == {"0 region": 3, "1 nations": plain[0], "2 customers": plain[1]} and trace.seconds > 0
    other = observed.Trace()
    rows = other.at(spark.range(10), "ten", top=F.max("id"))
    assert rows.count() == 10 and other.values() == {"ten": {"rows": 10, "top": 9}}
    with pytest.raises(ValueError):
        other.at(rows, "ten")
