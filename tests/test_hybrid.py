"""A keyword list that fails must not pass for an answer."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meshlark.operators import retrieval
from meshlark.plans import retrieval_queries

SF = "/root/testdata/sf0.001"


def lost(df):
    return df.withColumn("score", F.raise_error(F.lit("the list was lost")).cast("double"))


def test_a_failing_keyword_list_fails_the_fusion(spark):
    """Before, the dense rows came back as if they were fused."""
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, doc_id string, score double, rank int")
    for method in ("rrf", "dbsf"):
        with pytest.raises(PySparkException, match="the list was lost"):
            retrieval.hybrid(dense, lost(dense), 5, retrieval.HybridOptions(method=method))[0].collect()
    assert retrieval.hybrid(dense, lost(dense), 5, retrieval.HybridOptions(keyword=False))[0].count() == 2


def fails_with_its_list(spark, monkeypatch, name):
    found = retrieval_queries._keywords
    monkeypatch.setattr(retrieval_queries, "_keywords", lambda *a: [lost(x) for x in found(*a)])
    with pytest.raises(PySparkException, match="the list was lost"):
        retrieval_queries.C.queries[name](spark, SF).collect()


def test_hybrid_dbsf_fails_with_its_keyword_list(spark, monkeypatch):
    fails_with_its_list(spark, monkeypatch, "hybrid_dbsf")


def test_hybrid_rrf_fails_with_its_keyword_list(spark, monkeypatch):
    fails_with_its_list(spark, monkeypatch, "hybrid_rrf")
