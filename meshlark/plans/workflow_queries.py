"""Workflow logs: folds, illegal moves, gates, forks, loops, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions.text import backoff_schedule, word_count
from ..operators import retrieval
from ..operators import workflow as W
from ..streaming import folds
from .base import Catalogue, table, texts
from .retrieval_queries import BM25

C = Catalogue()
ENGLISH = BM25.replace("FROM documents", "FROM documents WHERE lang = 'en'")
ORDER = ["ts", "event_id"]


def example() -> W.Workflow:
    """view -> click -> (purchase | signup) with errors as failures: the events read as phases."""
    return W.Workflow("funnel").then("view", least_confidence=0.25, on_low_confidence="review", compensate="unview").then("click", least_confidence=0.5, on_low_confidence="ask").branch("choice", {"purchase": ["purchase"]}, ["signup"]).finish()


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("workflow_id"), F.col("event_type").alias("step"), "value", (F.col("event_type") != "error").alias("ok"), (F.col("value") / 100).alias("confidence"))


@C.model_check("""SELECT * FROM (VALUES ('NotStarted', 'view', ''), ('view', 'click', ''), ('click', 'choice', ''), ('choice', 'purchase', 'purchase'), ('choice', 'signup', '*'), ('purchase', 'Completed', ''), ('signup', 'Completed', ''),
  ('view', 'Failed', 'failed'), ('click', 'Failed', 'failed'), ('choice', 'Failed', 'failed'), ('purchase', 'Failed', 'failed'), ('signup', 'Failed', 'failed')) t(phase_from, phase_to, "case")""")
def workflow_transitions(spark, sf_dir):
    return W.Workflow.from_json(example().to_json()).transitions(spark).drop("workflow")


@C.model_check("SELECT * FROM (VALUES ('view', 'step', 'unview'), ('click', 'step', ''), ('choice', 'branch', ''), ('purchase', 'step', ''), ('signup', 'step', '')) t(step, kind, compensate)")
def workflow_steps(spark, sf_dir):
    return example().step_table(spark).select("step", "kind", "compensate")


@C.query("""WITH legal(a, b) AS (VALUES ('NotStarted', 'view'), ('view', 'click'), ('click', 'choice'), ('choice', 'purchase'), ('choice', 'signup'), ('purchase', 'Completed'), ('signup', 'Completed'), ('view', 'Failed'), ('click', 'Failed'), ('choice', 'Failed'), ('purchase', 'Failed'), ('signup', 'Failed')),
m AS (SELECT user_id AS workflow_id, event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'NotStarted') AS phase_from, event_type AS phase_to FROM events)
SELECT * FROM m WHERE (phase_from, phase_to) NOT IN (SELECT (a, b) FROM legal)""")
def illegal_transitions(spark, sf_dir):
    moves = W.illegal_moves(_log(spark, sf_dir), example().transitions(spark), "workflow_id", ORDER, "step")
    return moves.select("workflow_id", "event_id", "phase_from", "phase_to")


@C.query("""SELECT user_id AS workflow_id, max_by(event_type, event_id) AS step, sum(1) FILTER (event_type = 'purchase')::BIGINT AS n_purchases, round(max_by(value, event_id), 6) AS value, count(*) AS events,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS trail FROM (SELECT * FROM events ORDER BY ts, event_id) GROUP BY user_id""".replace("max_by(event_type, event_id)", "arg_max(event_type, (ts, event_id))").replace("max_by(value, event_id)", "arg_max(value, (ts, event_id))").replace("sum(1) FILTER (event_type = 'purchase')::BIGINT", "count(*) FILTER (event_type = 'purchase')"))
def state_fold_append_merge(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("last_by_step", F.create_map("step", "event_id")).withColumn("trail", F.col("event_id"))
    purchases = F.size(F.filter("trail_steps", lambda s: s == "purchase")).cast("long")
    s = W.fold_states(log.withColumn("trail_steps", F.col("step")), "workflow_id", ORDER, ["step", "value"], ["trail", "trail_steps"], ["last_by_step"])
    return s.select("workflow_id", "step", purchases.alias("n_purchases"), F.round("value", 6).alias("value"), "events", F.array_join(F.transform("trail", lambda x: x.cast("string")), ",").alias("trail"))


@C.query("SELECT user_id AS workflow_id, event_type AS kind, max_by(event_id, (ts, event_id)) AS last FROM events GROUP BY ALL".replace("max_by", "arg_max"))
def state_fold_map(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("last_by_step", F.create_map("step", "event_id"))
    s = W.fold_states(log, "workflow_id", ORDER, [], [], ["last_by_step"])
    return s.select("workflow_id", F.explode("last_by_step").alias("kind", "last"))


@C.query("SELECT event_id, CASE WHEN event_type = 'view' AND value / 100 < 0.25 THEN 'review' WHEN event_type = 'click' AND value / 100 < 0.5 THEN 'ask' ELSE 'next' END AS route FROM events")
def confidence_gate(spark, sf_dir):
    return W.confidence_gate(_log(spark, sf_dir), example().step_table(spark)).select("event_id", "route")


FORK = "paths AS (SELECT user_id AS workflow_id, event_id // 3 AS fork_id, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'FailedWithRecovery' WHEN 'signup' THEN 'Running' ELSE 'Success' END AS status FROM (SELECT event_id, event_type, event_id % 7 AS user_id FROM events))"


@C.query(f"WITH {FORK} SELECT fork_id, count(*) FILTER (status <> 'Running') = 3 AS ready, bool_and(status = 'Success') AS all_succeeded, bool_or(status = 'Failed') AS any_failed, bool_or(status = 'FailedWithRecovery') AS any_recovered FROM paths GROUP BY fork_id")
def fork_join_ready(spark, sf_dir):
    k = F.col("event_type")
    status = F.when(k == "error", "Failed").when(k == "click", "FailedWithRecovery").when(k == "signup", "Running").otherwise("Success")
    paths = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("fork_id"), status.alias("status"))
    return W.fork_status(paths, ["fork_id"], 3)


@C.query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'signup' END AS next FROM events")
def branch_route(spark, sf_dir):
    return W.branch_route(_log(spark, sf_dir), example().transitions(spark), "choice", F.col("step")).select("event_id", "next")


@C.query("SELECT user_id AS workflow_id, count(*) AS rounds, count(*) >= 10 AS exhausted, arg_max(value > 50, (ts, event_id)) AND count(*) < 10 AS goes_on FROM events WHERE event_type = 'click' GROUP BY user_id")
def loop_rounds(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("again", F.col("value") > 50)
    return W.loop_rounds(log, "workflow_id", "click", 10, ORDER)


@C.query("""WITH m AS (SELECT *, event_type = 'error' AS bad, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS any_failed FROM events)
SELECT user_id AS workflow_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, 'unview' AS compensate FROM m WHERE any_failed = 1 AND NOT bad AND coalesce(failed, 0) = 0 AND event_type = 'view'""")
def compensations(spark, sf_dir):
    return W.compensations(_log(spark, sf_dir), example().step_table(spark), "workflow_id", ORDER)


@C.query("SELECT event_id, coalesce(epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), now)) - epoch_us(ts) > 86400000000, false) AS timed_out FROM events, (SELECT max(ts) AS now FROM events)")
def timeouts(spark, sf_dir):
    log = _log(spark, sf_dir)
    now = log.agg(F.max("ts")).head()[0]
    return W.timeouts(log, "workflow_id", ORDER, "ts", F.lit(86400), F.lit(now).cast("timestamp_ntz")).select("event_id", "timed_out")


@C.query("""SELECT event_id, ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 2 AS granted
FROM (SELECT event_id, user_id, ts, event_type = 'error' AND value >= 50 OR event_type = 'click' AS ok FROM events)""")
def diagnostic_forks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", "ts", "user_id", F.col("event_type").alias("trigger"), F.create_map(F.lit("log"), F.when(F.col("value") >= 50, "found").otherwise(" ")).alias("evidence"))
    triggers = spark.createDataFrame([("error", ["log"]), ("click", [])], "trigger string, fields array<string>")
    return W.permitted_forks(asked, triggers, 2, "user_id", ORDER).select("event_id", "granted")


@C.query("SELECT event_type AS step, count(*) FILTER (value >= 20) AS completed, count(*) FILTER (value < 20) AS failed, round(avg(value), 6) AS mean_duration, round(quantile_cont(value, 0.5), 6) AS median_duration, round(quantile_cont(value, 0.95), 6) AS p95_duration FROM events GROUP BY event_type")
def step_telemetry(spark, sf_dir):
    return W.step_telemetry(_log(spark, sf_dir), "step", F.col("value") >= 20, F.col("value"))


@C.model_check("SELECT i AS attempt, least(1.0 * power(2.0, i), 60.0)::DOUBLE AS wait FROM range(9) t(i)")
def retry_backoff(spark, sf_dir):
    return spark.range(1).select(F.posexplode(backoff_schedule(9)).alias("attempt", "wait")).select(F.col("attempt").cast("long").alias("attempt"), "wait")


@C.query("SELECT conv_id, string_agg(content, chr(10) || chr(10) ORDER BY place) AS prompt FROM (SELECT conv_id, place, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn, text) AS content FROM (SELECT *, CASE role WHEN 'user' THEN 1 ELSE 2 END AS place FROM conversations) GROUP BY conv_id, place) GROUP BY conv_id")
def context_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parts = c.select("conv_id", F.when(F.col("role") == "user", 1).otherwise(2).alias("place"), F.col("turn").alias("item"), F.col("text").alias("content"))
    return W.assemble_context(parts, "conv_id")


FIRST_ASKED = "asked AS (SELECT conv_id AS item_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id)"


@C.query(rf"""WITH {FIRST_ASKED}, {ENGLISH.replace("FROM benchmark", "FROM asked")}, used AS (
  SELECT item_id, doc_id, rank, sum(len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM bm_ranked JOIN documents USING (doc_id) WHERE rank <= 5
), segments AS (
  SELECT conv_id, 0 AS place, turn AS item, text AS content FROM conversations WHERE role = 'system'
  UNION ALL SELECT item_id, 1, rank, text FROM used JOIN documents USING (doc_id) WHERE used <= 400
  UNION ALL SELECT item_id, 2, 0, text FROM asked)
SELECT conv_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY place)) AS prompt_sha256 FROM (SELECT conv_id, place, string_agg(content, chr(10) || '---' || chr(10) ORDER BY item, content) AS content FROM segments GROUP BY ALL) GROUP BY conv_id""")
def context_with_retrieval(spark, sf_dir):
    """A prompt for each conversation: its system texts, the best documents in a language that fit a budget, the question."""
    c, docs = table(spark, sf_dir, "conversations"), texts(spark, sf_dir, "documents")
    asked = c.filter("role = 'user' AND text IS NOT NULL").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    found = retrieval.bm25(asked, docs.filter("lang = 'en'"), 5, query_id="conv_id").join(docs.select("doc_id", word_count(F.col("text")).alias("words")), "doc_id")
    kept = W.within_budget(found, "conv_id", "rank", F.col("words"), 400).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    system = c.filter("role = 'system'").select("conv_id", F.lit(0).alias("place"), F.col("turn").alias("item"), F.col("text").alias("content"))
    question = asked.select("conv_id", F.lit(2).alias("place"), F.lit(0).cast("long").alias("item"), F.col("text").alias("content"))
    prompts = W.assemble_context(system.unionByName(W.retrieved_segments(kept, "conv_id", "rank", "content", 1)).unionByName(question), "conv_id")
    return prompts.select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@C.query("SELECT user_id AS key, lag(event_type) OVER w AS step_from, event_type AS step_to, lag(ts) OVER w AS since, ts AS at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)")
def steps_in_sql(spark, sf_dir):
    """A table function that asks for its partitioning itself, called from SQL."""
    table_functions.register(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("meshlark_log")
    return spark.sql("SELECT * FROM steps(TABLE(meshlark_log), 'user_id', 'event_type', 'ts')")


@C.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return folds.windowed_counts(table(spark, sf_dir, "events"))


@C.query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    return folds.sessions(table(spark, sf_dir, "events"))


BELIEFS = "SELECT user_id, CAST(2 + count(*) FILTER (event_type IN ('purchase', 'signup')) AS DOUBLE) AS alpha, CAST(2 + count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS DOUBLE) AS beta, count(*) AS events, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"


@C.query(BELIEFS)
def user_beliefs(spark, sf_dir):
    return folds.batch_beliefs(table(spark, sf_dir, "events"))
