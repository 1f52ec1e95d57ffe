"""The stored keyword index against BM25 over the documents."""

import random

import pytest
from pyspark.sql import functions as F

from meshlark.operators import keyword_index, retrieval


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([3, 20, 200])))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "w0 W0, w0!"), (1003, rows[5][1]), (1004, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w0 w1 w59"), (2, "w40 w41 w42 w43"), (3, "nowhere"), (4, None), (5, "W7 w7; w0"), (5, "w58")], "query_id int, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("chunk", [4096, 20])
def test_equals_bm25_in_one_segment_or_several(spark, docs, asked, tmp_path, chunk):
    want = rows(retrieval.bm25(asked, docs, 8))
    one = keyword_index.KeywordIndex(spark, str(tmp_path / "one"))
    one.append(docs, chunk=chunk)
    assert rows(one.search(asked, 8)) == want and len(want) > 20
    three = keyword_index.KeywordIndex(spark, str(tmp_path / "three"))
    for i in range(3):
        three.append(docs.filter(F.col("doc_id") % 3 == i), chunk=chunk)
    assert rows(three.search(asked, 8)) == want
    assert rows(three.search(asked.filter("query_id = 2"), 700, k1=2.0, b=0.0)) == rows(retrieval.bm25(asked.filter("query_id = 2"), docs, 700, k1=2.0, b=0.0))


def test_a_search_reads_no_documents_and_prunes_chunks(spark, tmp_path):
    source = str(tmp_path / "docs")
    spark.createDataFrame([(i, "rare " * (i == 77) + "often " * (1 + i % 3)) for i in range(400)], "doc_id long, text string").write.parquet(source)
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "index"))
    index.append(spark.read.parquet(source), chunk=10)
    seen, real = [], index._scored
    index._scored = lambda rows, wanted, pairs, *rest: (seen.append(pairs.count()), real(rows, wanted, pairs, *rest))[1]
    found = index.search(spark.createDataFrame([(1, "rare")], "query_id int, text string"), 1)
    assert [r["doc_id"] for r in found.collect()] == [77] and seen == [1, 0]  # no other chunk has the term
    assert not any(source in f for f in found.inputFiles())
    seen.clear()
    common = index.search(spark.createDataFrame([(1, "rare often")], "query_id int, text string"), 1)
    assert [r["doc_id"] for r in common.collect()] == [77] and seen == [2, 0]  # chunks of the frequent term alone stay below


def test_an_unfinished_segment_is_not_read(spark, docs, asked, tmp_path):
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"))
    index.append(docs)
    want = rows(index.search(asked, 5))
    spark.read.parquet(index.folder + "/postings/*").write.parquet(f"{index.folder}/postings/broken")
    assert rows(index.search(asked, 5)) == want
