"""Guarded starts, audit trails, typed events, usage and estimates over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, budget
from ..operators import workflow as W
from .base import Catalogue, table
from .workflow_queries import _log, example

C = Catalogue()
ORDER = ["ts", "event_id"]


def _guards():
    known = audit.Conditions()
    known.register("paid", lambda: F.col("value") >= 30)
    known.register("named", lambda: F.col("workflow_id") % 2 == 0)
    return known


@C.query("""SELECT event_id, CASE WHEN bad THEN 'ValidationFailed' ELSE event_type END AS phase, CASE WHEN bad THEN 'ValidationFailed' ELSE 'Dispatched' END AS event, CASE WHEN bad THEN CASE event_type WHEN 'purchase' THEN 'too little' ELSE 'no name' END END AS error,
  CASE WHEN NOT bad AND event_type = 'purchase' THEN 60000000 END AS left_us FROM (SELECT *, event_type = 'purchase' AND value < 30 OR event_type = 'signup' AND user_id % 2 <> 0 AS bad FROM events)""")
def validation_guard(spark, sf_dir):
    guarded = W.Workflow("guarded").then("view").then("signup", validate="named", message="no name").then("purchase", validate="paid", message="too little", timeout_s=60.0).finish()
    rows = audit.start_steps(_log(spark, sf_dir), guarded.step_table(spark), _guards())
    return rows.select("event_id", "phase", "event", "error", (F.unix_micros("deadline") - F.unix_micros(F.col("ts").cast("timestamp"))).alias("left_us"))


@C.query("""WITH w AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER o AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER o AS bad, lead(1) OVER o AS after,
  CASE event_type WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.5 END AS least, CASE event_type WHEN 'view' THEN 'review' WHEN 'click' THEN 'ask' END AS handler FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS workflow_id, event_id, 'Started' AS event, NULL AS detail FROM w WHERE n = 1 UNION ALL SELECT user_id, event_id, CASE WHEN ok THEN 'StepCompleted' ELSE 'StepFailed' END, NULL FROM w
UNION ALL SELECT user_id, event_id, 'LowConfidenceRouted', handler FROM w WHERE ok AND value / 100 < least UNION ALL SELECT user_id, event_id, 'Failed', event_type FROM w WHERE NOT ok AND bad = 1
UNION ALL SELECT user_id, event_id, 'Completed', NULL FROM w WHERE after IS NULL AND bad = 0""")
def audit_trail(spark, sf_dir):
    rows = audit.audit_events(_log(spark, sf_dir), example().step_table(spark), "workflow_id", ORDER)
    return rows.select("workflow_id", "event_id", "event", F.when(F.col("event") != "StepCompleted", F.col("detail")).alias("detail"))


@C.query("""SELECT user_id::VARCHAR AS workflow_id, event_id::VARCHAR AS task_id, 'failed at ' || event_id AS reason, value > 50 AS is_recoverable, round(value, 6) AS duration, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at FROM events WHERE event_type = 'error'""")
def failed_executions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.struct(
        F.col("user_id").cast("string").alias("workflow_id"), F.col("event_id").cast("string").alias("task_id"), F.concat(F.lit("failed at "), "event_id").alias("reason"), (F.col("value") > 50).alias("is_recoverable"),
        F.col("value").alias("duration"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    log = e.select(F.when(F.col("event_type") == "error", "ExecutionFailed").otherwise("TaskCompleted").alias("event"), F.to_json(body).alias("payload"))
    rows = audit.library_events(log, "ExecutionFailed")
    return rows.select("workflow_id", "task_id", "reason", "is_recoverable", F.round("duration", 6).alias("duration"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@C.query("SELECT event_id, event_type AS kind, user_id, NULL AS missing, NULL AS wrong FROM events WHERE event_type <> 'view'")
def json_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("data"))
    field = lambda name, kind="string": audit.json_field("data", name, kind)
    return rows.filter(field("event_type") != "view").select("event_id", field("event_type").alias("kind"), field("user_id", "bigint").alias("user_id"), field("absent").alias("missing"), field("event_type", "int").alias("wrong"))


@C.query("SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS executions, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS tool_calls, round(sum(value), 4) AS duration FROM events GROUP BY user_id")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    used = e.select("user_id", F.floor("value").cast("long").alias("tokens"), F.lit(1).cast("long").alias("executions"), F.when(F.col("event_type") == "click", 1).cast("long").alias("tool_calls"), F.col("value").alias("duration"))
    return budget.usage_totals(used, "user_id").withColumn("duration", F.round("duration", 4))


@C.query("SELECT doc_id, steps, steps * 2000 AS tokens, CAST(ceil(steps * 0.5) AS BIGINT) AS executions, CAST(steps * 2 AS BIGINT) AS tool_calls FROM (SELECT doc_id, CAST(ceil(n_chars / 1024 * 5 * 1.5) AS BIGINT) AS steps FROM documents)")
def budget_estimates(spark, sf_dir):
    options = budget.BudgetOptions(execution_ratio=0.5, tool_call_ratio=2.0, retry_margin=0.5)
    found = options.estimate(F.col("n_chars") / 1024)
    names = {"Steps": "steps", "Tokens": "tokens", "Executions": "executions", "ToolCalls": "tool_calls"}
    return table(spark, sf_dir, "documents").select("doc_id", *(found[k].cast("long").alias(n) for k, n in names.items()))
