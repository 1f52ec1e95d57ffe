"""Approvals, answers, coverage, attributed links, selections with priors, and what is left of the ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import valid_identity
from ..operators import bandit, ledger, loops, retrieval
from ..operators import decisions as D
from ..operators import workflow as W
from ..operators.relate import EDGE, relate_attributed, unrelate_attributed
from .base import Catalogue, table, texts
from .domain import model, outcomes
from .ledger_queries import OUT
from .retrieval_queries import BM25, OVERLAP

C = Catalogue()
ENGLISH = BM25.replace("FROM documents", "FROM documents WHERE lang = 'en'")


@C.query("""WITH req AS (SELECT user_id AS request, min(ts) AS asked_at FROM events WHERE event_type = 'view' GROUP BY user_id),
ans AS (SELECT request, arg_min(event_type, ts) AS kind, min(ts) AS answered FROM req JOIN events ON user_id = request AND ts >= asked_at AND event_type IN ('purchase', 'error') GROUP BY request),
w AS (SELECT request, kind, (epoch_us(coalesce(answered, (SELECT max(ts) FROM events))) - epoch_us(asked_at)) / 1000000 AS s FROM req LEFT JOIN ans USING (request))
SELECT request, CASE WHEN s <= 21600 THEN 'lead' WHEN s <= 108000 THEN 'manager' END AS level, CASE WHEN s > 108000 THEN 'expired' WHEN kind = 'purchase' THEN 'approved' WHEN kind = 'error' THEN 'rejected' ELSE 'waiting' END AS outcome FROM w""")
def approval_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("request")).agg(F.min("ts").alias("asked_at"))
    answers = e.filter("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("request"), F.col("ts").alias("answered_at"), (F.col("event_type") == "purchase").alias("approved"))
    now = e.agg(F.max("ts")).head()[0]
    return D.approval_outcomes(asked, answers, [("lead", 21_600), ("manager", 86_400)], F.lit(now).cast("timestamp_ntz"))


@C.query(f"""WITH {OVERLAP}, top AS (SELECT * FROM ov_ranked WHERE rank <= 5), hit AS (SELECT item_id, count(*) FILTER (score >= 0.9) AS n FROM top GROUP BY item_id)
SELECT item_id, CASE WHEN n > 0 THEN 'answer' ELSE 'abstain' END AS outcome, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (score >= 0.9 OR (n = 0 AND rank <= 3)) AS records FROM top JOIN hit USING (item_id) GROUP BY item_id, n""")
def answer_or_abstain(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    scored = retrieval.overlap_scores(q, texts(spark, sf_dir, "documents"), 5, query_id="item_id", query_text="question")
    rows = D.answer_or_abstain(q, scored, 0.9, question_id="item_id")
    return rows.select("item_id", "outcome", F.array_join(F.transform("records", lambda x: x.cast("string")), ",").alias("records"))


@C.query("SELECT source, count(l.doc_id) AS covered, count(*) AS total, count(*) - count(l.doc_id) AS uncovered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def label_coverage(spark, sf_dir):
    return D.coverage(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", ["source"])


@C.model_check("SELECT * FROM (VALUES ('modifies', 'c_acctbal')) t(effect, subject)")
def action_effects(spark, sf_dir):
    return D.effects(model().frames(spark), "customer", "close")


@C.model_check("SELECT * FROM (VALUES ('customer', 'contact'), ('supplier', NULL)) t(type, action)")
def interface_actions(spark, sf_dir):
    return D.resolved_actions(model().frames(spark), "Party", "reach").select("type", "action")


# -- links with attributes -----------------------------------------------------------------


@C.query("SELECT 'a' || c_custkey AS id, c_acctbal AS strength FROM customer WHERE c_custkey % 30 < 25 AND c_nationkey <> c_custkey % 30 AND c_custkey > 10 AND c_acctbal >= 0")
def relate_attributed_store(spark, sf_dir):
    c, text = table(spark, sf_dir, "customer"), lambda x: x.cast("string")
    nations = table(spark, sf_dir, "nation").select(F.lit("nation").alias("type"), text(F.col("n_nationkey")).alias("id"))
    name = F.concat(F.lit("a"), text(F.col("c_custkey")))
    wanted = c.select(F.lit("nation").alias("src_type"), text(F.col("c_nationkey")).alias("src_id"), F.lit("allied").alias("link"), F.lit("nation").alias("tgt_type"), text(F.col("c_custkey") % 30).alias("tgt_id"), name.alias("assoc_id"), "c_custkey")
    links = spark.createDataFrame([("nation", "allied", "nation", False)], "src_type string, link string, tgt_type string, self_loops boolean")
    objects = c.filter("c_acctbal >= 0").select(name.alias("id"), F.col("c_acctbal").alias("strength"))
    return relate_attributed(wanted, wanted.filter("c_custkey <= 10"), nations, links, objects)[1]


@C.query("SELECT 'g' || n_nationkey % 5 AS assoc_id, count(*) FILTER (n_nationkey >= 21) AS edges FROM nation GROUP BY n_nationkey % 5 HAVING count(*) FILTER (n_nationkey >= 21) > 0")
def unrelate_attributed_rest(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    group = F.concat(F.lit("g"), (F.col("n_nationkey") % 5).cast("string"))
    edges = n.select(F.lit("nation").alias("src_type"), F.col("n_nationkey").cast("string").alias("src_id"), F.lit("allied").alias("link"), F.lit("nation").alias("tgt_type"), F.col("n_regionkey").cast("string").alias("tgt_id"), group.alias("assoc_id"), "n_nationkey")
    left, kept = unrelate_attributed(edges.select(*EDGE), n.select(group.alias("id")).distinct(), edges.filter("n_nationkey < 21"))
    return left.groupBy("assoc_id").agg(F.count("*").alias("edges")).join(kept.withColumnRenamed("id", "assoc_id"), "assoc_id")


# -- selection, loops, ledgers -------------------------------------------------------------------


@C.query(f"""WITH {OUT}, known AS (SELECT agent, category, 2.0 + count(*) FILTER (success) AS a, 2.0 + count(*) FILTER (NOT success) AS b, count(*) AS n FROM outcomes GROUP BY ALL), priors(agent, category, pa, pb) AS (VALUES (5, 'click', 30.0, 10.0), (6, 'click', 1.0, 3.0), (0, 'view', 99.0, 1.0)),
c AS (SELECT 'r-' || category AS request, category, agent FROM (VALUES ('view'), ('click'), ('purchase')) x(category), range(7) y(agent)),
t AS (SELECT request, agent, coalesce(n, 0) AS n, CAST(coalesce(a, pa, 2) AS DOUBLE) / (coalesce(a, pa, 2) + coalesce(b, pb, 2)) AS theta FROM c LEFT JOIN known USING (agent, category) LEFT JOIN priors USING (agent, category))
SELECT request, agent, round(theta, 6) AS theta, least(1, n / 20) AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY request ORDER BY theta DESC, agent) = 1""")
def contextual_select(spark, sf_dir):
    known = bandit.beliefs(outcomes(table(spark, sf_dir, "events")), "agent", "category", F.col("success"))
    candidates = spark.createDataFrame([(f"r-{c}", c, a, a) for c in ("view", "click", "purchase") for a in range(7)], "request string, category string, agent long, position int")
    priors = spark.createDataFrame([(5, "click", 30.0, 10.0), (6, "click", 1.0, 3.0), (0, "view", 99.0, 1.0)], "agent long, category string, alpha double, beta double")
    return bandit.select(known, candidates, priors=priors).withColumn("theta", F.round("theta", 6))


@C.query(r"""WITH last5 AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5),
s AS (SELECT a.conv_id, max(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS s FROM last5 a JOIN last5 b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) > 0 AND len(b.w) > 0 GROUP BY a.conv_id)
SELECT conv_id, round(coalesce(s, 0), 6) AS semantic FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)""")
def loop_semantic(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(True).alias("progress"), F.lit(None).cast("string").alias("signal"))
    return loops.verdicts(log, "conv_id", ["turn"], "role", "progress", "signal", F.col("text")).select("conv_id", F.round("semantic", 6).alias("semantic"))


@C.query("""WITH last5 AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 5)
SELECT label, round(greatest(coalesce(max(list_cosine_similarity(a.v, b.v)) FILTER (a.vec_id < b.vec_id), 0), 0), 6) AS semantic FROM last5 a JOIN last5 b USING (label) GROUP BY label""")
def loop_by_vectors(spark, sf_dir):
    """Likeness of outputs by their vectors instead of their words."""
    log = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.lit("say").alias("action"), F.lit(True).alias("progress"), F.lit(None).cast("string").alias("signal"))
    found = loops.verdicts(log, "label", ["vec_id"], "action", "progress", "signal", F.col("embedding"), similar=loops.vector_similarity)
    return found.select("label", F.round("semantic", 6).alias("semantic"))


@C.query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def task_versions(spark, sf_dir):
    return ledger.latest_versions(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


@C.query("SELECT event_id FROM events WHERE ts > (SELECT min(ts) FROM events WHERE event_type = 'error')")
def entries_after(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    moment = e.filter("event_type = 'error'").agg(F.min("ts")).head()[0]
    return ledger.after(e, "ts", F.lit(moment).cast("timestamp_ntz")).select("event_id")


@C.query("SELECT event_id, sha256(CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR)) AS input FROM events")
def input_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ledger.input_hash("event_id", "event_type").alias("input"))


@C.query("SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'v0' WHEN event_type = 'click' AND user_id % 3 = 1 THEN 'c1' END AS definition FROM events")
def catalog_resolve(spark, sf_dir):
    catalog = spark.createDataFrame([("view", "0", "late", 1), ("view", "0", "v0", 0), ("click", "1", "c1", 0), ("error", "9", "e9", 0)], "workflow_id string, version string, definition string, position int")
    wanted = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("workflow_id"), (F.col("user_id") % 3).cast("string").alias("version"))
    return W.catalog_resolve(wanted, catalog).select("event_id", "definition")


# -- texts ------------------------------------------------------------------------------------------


def _features():
    lists = [(n, "[" + ", ".join(f"'{w}'" for w in words) + "]") for n, words in T.CATEGORIES.items()]
    case = "CASE " + " ".join(f"WHEN len(list_filter({x}, lambda w: contains(low, w))) > 0 THEN '{n}'" for n, x in lists) + f" ELSE '{T.GENERAL}' END"
    found = "CASE category " + " ".join(f"WHEN '{n}' THEN array_to_string(list_filter({x}, lambda w: contains(low, w)), ',')" for n, x in lists) + " ELSE '' END"
    return f"SELECT doc_id, category, {found} AS keywords FROM (SELECT *, {case} AS category FROM (SELECT doc_id, lower(text) AS low FROM documents))"


@C.query(_features())
def task_features(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", T.classify(F.col("text")).alias("category"))
    return rows.select("doc_id", "category", F.array_join(T.matched_keywords(F.col("text"), F.col("category")), ",").alias("keywords"))


@C.query(f"WITH {ENGLISH} SELECT item_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 5")
def keyword_metadata(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    return retrieval.keyword_search(table(spark, sf_dir, "benchmark"), {"documents": docs}, "documents", 5, {"lang": "en"}, query_id="item_id")


@C.query(r"SELECT doc_id, regexp_full_match(text, '[\x20-\x7E]+') AND trim(text) <> '' AS valid FROM documents")
def valid_identities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", valid_identity(F.col("text")).alias("valid"))
