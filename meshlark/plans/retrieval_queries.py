"""Vector, keyword and hybrid retrieval; chunks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions import text as T
from ..functions.vectors import vector_literal
from ..operators import chunking, keyword_index, retrieval, vector_index
from ..sources.lineage import cut_lineage, shared_folder
from .base import Catalogue, table, texts
from .domain import graph

C = Catalogue()
COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark, sf_dir):
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 7").select("embedding").head()
    return vector_literal(row[0])


def _similar(spark, sf_dir, **options):
    s = graph(spark, sf_dir).objects("embeddings").similar(_query_vector(spark, sf_dir), "embedding", **options)
    return s.df.select("vec_id", F.round("_score", 6).alias("score"))


@C.query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return _similar(spark, sf_dir, top=10, least=0.0)


@C.query("SELECT e.vec_id, round(1 / (1 + list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return _similar(spark, sf_dir, top=10, least=0.0, metric="l2")


@C.query("SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def knn_ip(spark, sf_dir):
    return _similar(spark, sf_dir, top=10, least=0.0, metric="inner_product")


@C.query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND {COSINE} >= 0.2 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def knn_min_relevance(spark, sf_dir):
    return _similar(spark, sf_dir, top=20, least=0.2)


@C.query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.label = 3 ORDER BY {COSINE} DESC, e.vec_id LIMIT 5")
def knn_prefilter(spark, sf_dir):
    return _similar(spark, sf_dir, top=5, least=0.0, filters={"label": 3})


@C.query(f"SELECT vec_id, score FROM (SELECT e.vec_id, e.label, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 ORDER BY {COSINE} DESC, e.vec_id LIMIT 30) WHERE label = 3")
def knn_postfilter(spark, sf_dir):
    return _similar(spark, sf_dir, top=30, least=0.0, post_filter=F.col("label") == 3)


@C.query(f"SELECT query_id, item_id, round(s, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE r <= 5")
def knn_batch_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.nearest(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@C.query("SELECT doc_id, round(len(list_filter(string_split('the and License xyz the', ' '), lambda t: contains(lower(text), lower(t)))) / 5, 6) AS score FROM documents")
def keyword_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.keyword_overlap(F.col("text"), F.lit("the and License xyz the")), 6).alias("score"))


BM25 = r"""terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[^\s.,;:!?]+')) AS term FROM benchmark),
cut AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\s.,;:!?]+') AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM cut),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM cut) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY ALL),
bm_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""


def _keywords(spark, sf_dir, top, rankings):
    """Lists of documents for each benchmark item, one for each ranking, from the same two scans."""
    found = retrieval.bm25_lists(table(spark, sf_dir, "benchmark"), texts(spark, sf_dir, "documents"), top, rankings, query_id="item_id")
    if len(rankings) == 1:
        return [found.drop("list")]
    found = cut_lineage(found)  # the best of each item, read once a list
    return [found.filter(F.col("list") == i).drop("list") for i in range(len(rankings))]


@C.query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _keywords(spark, sf_dir, 10, PLAIN)[0]


OVERLAP = """words AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda t: t <> '') AS w FROM benchmark),
ov AS (SELECT item_id, doc_id, round(len(list_filter(w, lambda t: contains(lower(d.text), t))) / len(w), 6) AS score FROM words, documents d),
ov_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ov)"""


@C.query(f"WITH {OVERLAP} SELECT item_id, doc_id, score, rank FROM ov_ranked WHERE rank <= 5")
def keyword_overlap_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return retrieval.overlap_scores(q, texts(spark, sf_dir, "documents"), 5, query_id="item_id", query_text="question")


# A second ranking of the same documents, without regard to their lengths.
SECOND = """flat AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3.0 / (tf + 2.0)), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY ALL),
flat_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM flat)"""
PLAIN, BOTH = [(1.2, 0.75)], [(1.2, 0.75), (2.0, 0.0)]


@C.query(f"""WITH {BM25}, {SECOND}, parts AS (SELECT item_id, doc_id, 1 / (60 + rank) AS p FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, 1 / (60 + rank) FROM flat_ranked WHERE rank <= 20),
f AS (SELECT item_id, doc_id, sum(p) AS s FROM parts GROUP BY ALL) SELECT item_id, doc_id, round(s, 6) AS fused_score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 10""")
def rrf_fuse(spark, sf_dir):
    f = retrieval.reciprocal_rank_fusion(_keywords(spark, sf_dir, 20, BOTH), 10, query_id="item_id")
    return f.select("item_id", "doc_id", F.round("fused_score", 6).alias("fused_score"))


@C.query(f"""WITH {BM25}, {SECOND}, parts AS (SELECT item_id, doc_id, 0.7 / (10 + rank) AS p FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, 0.3 / (10 + rank) FROM flat_ranked WHERE rank <= 20),
f AS (SELECT item_id, doc_id, sum(p) AS s FROM parts GROUP BY ALL) SELECT item_id, doc_id, round(s, 6) AS fused_score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 10""")
def rrf_weighted(spark, sf_dir):
    f = retrieval.reciprocal_rank_fusion(_keywords(spark, sf_dir, 20, BOTH), 10, k=10, weights=[0.7, 0.3], query_id="item_id")
    return f.select("item_id", "doc_id", F.round("fused_score", 6).alias("fused_score"))


@C.query(f"""WITH {BM25}, {SECOND}, pair AS (SELECT 1 AS l, item_id, doc_id, score FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT 2, item_id, doc_id, score FROM flat_ranked WHERE rank <= 20),
m AS (SELECT *, avg(score) OVER w AS mean, stddev_samp(score) OVER w AS sd FROM pair WINDOW w AS (PARTITION BY l, item_id)),
f AS (SELECT item_id, doc_id, sum(CASE WHEN sd IS NULL OR sd < 1e-9 THEN 0.5 ELSE (score - (mean - 3 * sd)) / (6 * sd) END) AS s FROM m GROUP BY ALL)
SELECT item_id, doc_id, round(s, 6) AS fused_score FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 10""")
def dbsf_fuse(spark, sf_dir):
    f = retrieval.distribution_fusion(_keywords(spark, sf_dir, 20, BOTH), 10, query_id="item_id")
    return f.select("item_id", "doc_id", F.round("fused_score", 6).alias("fused_score"))


def _vector_sql(name, table, key):
    return rf"""{name} AS (SELECT {key}, i, sum(s) AS v FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 2))::INT % 64 AS i, CASE WHEN substr(md5(w), 3, 1) >= '8' THEN 1 ELSE -1 END AS s
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[^ \t\n\x0b\f\r]+')) AS w FROM {table})) GROUP BY ALL),
{name}_len AS (SELECT {key}, sqrt(sum(v * v)) AS len FROM {name} GROUP BY {key})"""


DENSE = f"""{_vector_sql("dv", "documents", "doc_id")}, {_vector_sql("qv", "benchmark", "item_id")},
dots AS (SELECT item_id, doc_id, sum(dv.v * qv.v) AS dot FROM dv JOIN qv USING (i) GROUP BY ALL),
dense AS (SELECT b.item_id, d.doc_id, round(CASE WHEN dl.len * ql.len > 0 THEN coalesce(dot, 0) / (dl.len * ql.len) ELSE 0 END, 12) AS score
  FROM benchmark b CROSS JOIN documents d LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN dv_len dl USING (doc_id) LEFT JOIN qv_len ql USING (item_id)),
dense_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM dense)"""


def _dense(spark, sf_dir, top):
    """The nearest documents of each benchmark item by embedded texts."""
    vectors = lambda name, key: chunking.embed(texts(spark, sf_dir, name).select(key, "text"), "text", chunking.hashing_embedder(64, unit=False)).select(key, F.col("embedding").alias("vector"))
    return retrieval.nearest(vectors("benchmark", "item_id"), vectors("documents", "doc_id"), top, query_id="item_id", item_id="doc_id")


@C.query(f"WITH {DENSE} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM dense_ranked WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@C.query(f"""WITH {BM25}, {DENSE}, parts AS (SELECT item_id, doc_id, 1 / (60 + rank) AS p FROM dense_ranked WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, 1 / (60 + rank) FROM bm_ranked WHERE rank <= 50),
f AS (SELECT item_id, doc_id, sum(p) AS s FROM parts GROUP BY ALL), top AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10)
SELECT item_id, doc_id, round(o.score, 6) AS score, t.rank FROM top t JOIN dense_ranked o USING (item_id, doc_id) WHERE o.rank <= 50""")
def hybrid_rrf(spark, sf_dir):
    dense = cut_lineage(_dense(spark, sf_dir, 50))  # at most 50 rows an item, read twice
    return retrieval.hybrid(dense, _keywords(spark, sf_dir, 50, PLAIN)[0], 10, query_id="item_id")[0].withColumn("score", F.round("score", 6))


@C.query(f"""WITH {BM25}, {DENSE}, pair AS (SELECT 0.7 AS w, 1 AS l, item_id, doc_id, score FROM dense_ranked WHERE rank <= 50 UNION ALL SELECT 0.3, 2, item_id, doc_id, score FROM bm_ranked WHERE rank <= 50),
m AS (SELECT *, avg(score) OVER v AS mean, stddev_samp(score) OVER v AS sd FROM pair WINDOW v AS (PARTITION BY l, item_id)),
f AS (SELECT item_id, doc_id, sum(w * CASE WHEN sd IS NULL OR sd < 1e-9 THEN 0.5 ELSE (score - (mean - 3 * sd)) / (6 * sd) END) AS s FROM m GROUP BY ALL), top AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM f QUALIFY rank <= 10)
SELECT item_id, doc_id, round(o.score, 6) AS score, CAST(t.rank AS INTEGER) AS rank FROM top t JOIN dense_ranked o USING (item_id, doc_id) WHERE o.rank <= 50""")
def hybrid_dbsf(spark, sf_dir):
    options = retrieval.HybridOptions(method="dbsf", weights=(0.7, 0.3))
    dense = cut_lineage(_dense(spark, sf_dir, 50))
    return retrieval.hybrid(dense, _keywords(spark, sf_dir, 50, PLAIN)[0], 10, options, query_id="item_id")[0].withColumn("score", F.round("score", 6))


@C.query(f"WITH {DENSE} SELECT item_id, doc_id, round(score, 6) AS score, rank, 'no-keyword-provider' AS degraded FROM dense_ranked WHERE rank <= 5")
def hybrid_without_keywords(spark, sf_dir):
    rows, done = retrieval.hybrid(_dense(spark, sf_dir, 50), None, 5, query_id="item_id")
    return rows.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.lit(done["degraded"]).alias("degraded"))


@C.query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@C.query(r"SELECT doc_id, CAST(CASE WHEN n = 0 AND length(text) = 0 THEN 0 WHEN n <= 682 THEN 1 ELSE ceil(n / 597.0) END AS BIGINT) AS chunks FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)")
def chunk_fixed_counts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    n = chunking.chunk(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


def _sentence_sql(units, size, back, name):
    """CTEs from ``units`` (uid, text) to ``{name}`` (uid, first, sub, a, b): sentence chunks with their places in the text."""
    return rf"""{name}_pieces AS (SELECT uid, i, p[i] AS piece, CAST(coalesce(list_sum([len(y) for y in p[1:i - 1]]), 0) AS BIGINT) AS off
  FROM (SELECT uid, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT uid, string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM {units}))),
{name}_s AS (SELECT uid, piece, off, CAST(row_number() OVER (PARTITION BY uid ORDER BY i) - 1 AS BIGINT) AS k, off + len(regexp_extract(piece, '^\s*')) AS a, off + len(piece) AS b, len(regexp_extract_all(piece, '\S+')) AS words
  FROM {name}_pieces WHERE regexp_matches(piece, '\S')),
{name}_d AS (SELECT uid, count(*) AS n, list(a ORDER BY k) AS starts, list(b ORDER BY k) AS ends, sum(words) AS total, list_prepend(0::BIGINT, list(cum ORDER BY k)) AS c FROM (SELECT *, CAST(sum(words) OVER (PARTITION BY uid ORDER BY k) AS BIGINT) AS cum FROM {name}_s) GROUP BY uid),
{name}_walk AS (SELECT uid, 0::BIGINT AS first, greatest(1, len(list_filter(c, lambda x: x <= {size})) - 1)::BIGINT AS j FROM {name}_d WHERE total > {size}
  UNION ALL SELECT uid, nxt, greatest(nxt + 1, len(list_filter(c, lambda x: x <= c[nxt + 1] + {size})) - 1)::BIGINT
  FROM (SELECT d.uid, d.c, d.n, CASE WHEN len(list_filter(d.c[1:w.j], lambda x: x <= d.c[w.j + 1] - {back})) - 1 > w.first THEN len(list_filter(d.c[1:w.j], lambda x: x <= d.c[w.j + 1] - {back})) - 1 ELSE w.j END AS nxt FROM {name}_walk w JOIN {name}_d d USING (uid) WHERE w.j < d.n)),
{name}_wide AS (SELECT w.uid, w.first, off, regexp_extract_all(piece, '\S+') AS ws, string_split_regex(piece, '\S+') AS g FROM {name}_walk w JOIN {name}_s s ON s.uid = w.uid AND s.k = w.first WHERE w.j = w.first + 1 AND s.words > {size}),
{name} AS (
  SELECT uid, 0 AS first, 0 AS sub, 0 AS a, len(text) AS b FROM {units} JOIN {name}_d USING (uid) WHERE total <= {size}
  UNION ALL SELECT w.uid, w.first, 0, d.starts[w.first + 1], d.ends[w.j] FROM {name}_walk w JOIN {name}_d d USING (uid) WHERE NOT (w.j = w.first + 1 AND d.c[w.j + 1] - d.c[w.j] > {size})
  UNION ALL SELECT uid, first, i, off + list_sum([len(y) for y in g[1:i + 1]]) + coalesce(list_sum([len(y) for y in ws[1:i]]), 0), off + list_sum([len(y) for y in g[1:least(i + {size}, len(ws))]]) + list_sum([len(y) for y in ws[1:least(i + {size}, len(ws))]])
  FROM (SELECT *, unnest(range(0, len(ws), {size})) AS i FROM {name}_wide))"""


_PLACES = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INTEGER) AS chunk, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS \"end\""


@C.query(f"WITH RECURSIVE units AS (SELECT doc_id AS uid, text FROM documents), {_sentence_sql('units', 170, 21, 'sc')} SELECT uid AS doc_id, {_PLACES.format(order='first, sub').replace('PARTITION BY doc_id', 'PARTITION BY uid')} FROM sc")
def chunk_sentences(spark, sf_dir):
    return chunking.chunk(texts(spark, sf_dir, "documents"), "doc_id", "text", "sentence", 128, 16).drop("content")


@C.query(C.sql["chunk_sentences"])
def chunk_in_sql(spark, sf_dir):
    """The chunker as a table function, called from SQL for each row."""
    table_functions.register(spark)
    texts(spark, sf_dir, "documents").createOrReplaceTempView("meshlark_texts")
    return spark.sql("SELECT d.doc_id, c.chunk, c.start, c.end FROM meshlark_texts d, LATERAL chunk_text(d.text, 'sentence', 128, 16) c")


@C.query(rf"""WITH RECURSIVE pars AS (SELECT doc_id, text, i, p[i] AS piece, CAST(coalesce(list_sum([len(y) for y in p[1:i - 1]]), 0) + 2 * (i - 1) AS BIGINT) AS off, len(regexp_extract_all(p[i], '\S+')) AS words
  FROM (SELECT doc_id, text, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS p FROM documents))),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS k FROM pars WHERE words > 0),
d AS (SELECT doc_id, count(*) AS n, list(off ORDER BY k) AS starts, list(off + len(piece) ORDER BY k) AS ends, sum(words) AS total, any_value(text) AS text, list_prepend(0::BIGINT, list(cum ORDER BY k)) AS c
  FROM (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS cum FROM q) GROUP BY doc_id),
walk AS (SELECT doc_id, 0::BIGINT AS first, greatest(1, len(list_filter(c, lambda x: x <= 682)) - 1)::BIGINT AS j FROM d WHERE total > 682
  UNION ALL SELECT w.doc_id, w.j, greatest(w.j + 1, len(list_filter(d.c, lambda x: x <= d.c[w.j + 1] + 682)) - 1)::BIGINT FROM walk w JOIN d USING (doc_id) WHERE w.j < d.n),
units AS (SELECT w.doc_id || '/' || w.first AS uid, w.doc_id AS doc, w.first AS par, q.off AS base, q.piece AS text FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.k = w.first WHERE w.j = w.first + 1 AND q.words > 682),
{_sentence_sql('units', 682, 85, 'sc')},
spans AS (SELECT doc_id, 0 AS par, 0 AS first, 0 AS sub, 0 AS a, len(text) AS b FROM d WHERE total <= 682
  UNION ALL SELECT w.doc_id, w.first, 0, 0, d.starts[w.first + 1], d.ends[w.j] FROM walk w JOIN d USING (doc_id) WHERE NOT (w.j = w.first + 1 AND d.c[w.j + 1] - d.c[w.j] > 682)
  UNION ALL SELECT doc, units.par, sc.first, sub, base + a, base + b FROM sc JOIN units USING (uid))
SELECT doc_id, {_PLACES.format(order='par, first, sub')}, 64 AS dimensions FROM spans""")
def ingest_embeddings(spark, sf_dir):
    rows = chunking.embed(chunking.chunk(texts(spark, sf_dir, "documents"), "doc_id", "text", "paragraph"), "content", chunking.hashing_embedder())
    return rows.select("doc_id", "chunk", "start", "end", F.size("embedding").alias("dimensions"))


def _case(lists):
    out = "CASE"
    for name, words in lists.items():
        out += " WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'"
    return out + f" ELSE '{T.GENERAL}' END"


@C.query(f"SELECT doc_id, {_case(T.CATEGORIES)} AS category FROM documents")
def classify_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.classify(F.col("text")).alias("category"))


@C.query("SELECT doc_id, round(least(length(text) / 500.0, 1) * 0.5 + least((length(text) - length(replace(text, '.', ''))) / 10.0, 1) * 0.5, 6) AS complexity FROM documents")
def complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.complexity(F.col("text")), 6).alias("complexity"))


@C.query("SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_facets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"))


@C.query(f"""SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label IN (3, 7))) WHERE r <= 5""")
def vector_index_filtered(spark, sf_dir):
    """A filtered search over the index with every cell in reach, so that its lists are exact."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    index = vector_index.build(e, shared_folder(spark), 16, columns=("label",))
    queries = e.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "vector")
    found = vector_index.search(index, queries, 5, F.col("label").isin(3, 7), vector_index.STRICT, probes=16)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@C.query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 10")
def keyword_index_topk(spark, sf_dir):
    """BM25 from a stored index of two segments; the search reads postings, not documents."""
    index, docs = keyword_index.KeywordIndex(spark, shared_folder(spark)), texts(spark, sf_dir, "documents")
    index.append(docs.filter("lang = 'en'"))
    index.append(docs.filter("lang <> 'en' OR lang IS NULL"))
    return index.search(table(spark, sf_dir, "benchmark"), 10, query_id="item_id")
