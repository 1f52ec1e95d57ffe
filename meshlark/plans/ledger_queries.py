"""Ledgers, loops, budgets, beliefs and intervals over the event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import bandit, budget, ledger, loops, temporal
from ..sources import arrow_files, keyed
from ..sources.lineage import shared_folder
from ..sources.tables import query_events
from .base import Catalogue, table
from .domain import assertions, outcomes, progress

C = Catalogue()
ORDER = ["ts", "event_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@C.query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 5 AND ts >= (SELECT min(ts) FROM events WHERE false) OR (user_id = 5 AND event_type IN ('view', 'error') AND ts >= TIMESTAMP '2000-01-01')")
def event_query(spark, sf_dir):
    e = query_events(_events(spark, sf_dir), object_id="5", since=datetime(2000, 1, 1), kinds=["view", "error"], id_col="user_id")
    return e.select("event_id", "user_id", "event_type")


@C.query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'error') AND ts >= TIMESTAMP '2000-01-01' AND value >= 50")
def event_query_by_source(spark, sf_dir):
    """An event query over a data source of one's own, which takes the filters."""
    arrow_files.register(spark)
    rows = query_events(spark.read.format(arrow_files.NAME).load(f"{sf_dir}/events.parquet"), since=datetime(2000, 1, 1), kinds=["view", "error"])
    return rows.filter("value >= 50").select("event_id", "user_id", "event_type")


@C.query("SELECT task, count(*) AS entries, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, round(sum(value), 4) AS duration, count(*) FILTER (signal = 'Success') AS successes, count(*) FILTER (signal = 'Failure') AS failures, count(DISTINCT action) AS artifacts FROM (SELECT user_id AS task, value, event_type AS action, CASE event_type WHEN 'error' THEN 'Failure' WHEN 'purchase' THEN 'Success' END AS signal FROM events) GROUP BY task")
def progress_metrics(spark, sf_dir):
    p = progress(_events(spark, sf_dir))
    m = ledger.progress_metrics(p, "task", F.floor("value").cast("long"), F.col("value"), F.array("action"), F.col("signal"))
    return m.withColumn("duration", F.round("duration", 4))


@C.query("SELECT task, event_id, CAST(place AS INTEGER) AS place FROM (SELECT user_id AS task, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def recent_entries(spark, sf_dir):
    return ledger.recent(progress(_events(spark, sf_dir)), "task", ORDER, 5).select("task", "event_id", "place")


WINDOW = """last5 AS (SELECT task, list(action ORDER BY place DESC) AS a, count(*) AS n, avg(CASE WHEN action IN ('purchase', 'signup') THEN 0 ELSE 1 END) AS no_progress, avg(CASE WHEN action = 'error' THEN 1 ELSE 0 END) AS frustration
  FROM (SELECT user_id AS task, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5 GROUP BY task),
scored AS (SELECT *, list_max(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)))) / n AS repetition,
  CASE WHEN n < 4 THEN 0 ELSE len(list_filter(range(2, CAST(n AS INTEGER)), lambda i: a[i + 1] = a[i % 2 + 1])) / (n - 2) END AS oscillation FROM last5),
summed AS (SELECT *, 0.4 * repetition + 0.2 * no_progress + 0.1 * frustration AS s FROM scored)"""


def _verdicts(spark, sf_dir):
    return loops.verdicts(progress(_events(spark, sf_dir)), "task", ORDER, "action", "progress", "signal")


@C.query(f"WITH {WINDOW} SELECT task, n AS entries, round(repetition, 6) AS repetition, round(no_progress, 6) AS no_progress, round(frustration, 6) AS frustration FROM summed")
def loop_repetition(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("task", F.col("entries").cast("long").alias("entries"), *(F.round(c, 6).alias(c) for c in ("repetition", "no_progress", "frustration")))


@C.query(f"WITH {WINDOW} SELECT task, round(oscillation, 6) AS oscillation FROM summed")
def loop_oscillation(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("task", F.round("oscillation", 6).alias("oscillation"))


@C.query(f"""WITH {WINDOW}, judged AS (SELECT *, CASE WHEN n < 5 THEN NULL WHEN repetition >= 1 THEN 'ExactRepetition' WHEN no_progress >= 1 THEN 'NoProgress' WHEN oscillation >= 0.8 THEN 'Oscillation'
  WHEN s >= 0.7 THEN CASE WHEN no_progress >= repetition THEN 'NoProgress' ELSE 'ExactRepetition' END END AS loop_type FROM summed)
SELECT task, loop_type, round(CASE WHEN n < 5 THEN 0 WHEN repetition >= 1 OR no_progress >= 1 THEN 0.7 WHEN oscillation >= 0.8 THEN greatest(s + 0.5 * oscillation, 0.7) ELSE s END, 6) AS confidence,
  CASE loop_type WHEN 'ExactRepetition' THEN 'InjectVariation' WHEN 'NoProgress' THEN 'Decompose' WHEN 'Oscillation' THEN 'Synthesize' END AS strategy FROM judged""")
def loop_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("task", "loop_type", F.round("confidence", 6).alias("confidence"), "strategy")


@C.query("SELECT task_id, CAST(priority AS INTEGER) AS priority FROM (SELECT event_id AS task_id, user_id % 7 AS priority, event_type FROM events) t WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest([t.task_id - 1, t.task_id - 2]) AS need) WHERE need >= 0 AND need NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase'))")
def ready_tasks(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "view", "Pending").when(kind == "purchase", "Completed").otherwise("Running")
    need = F.filter(F.array(F.col("event_id") - 1, F.col("event_id") - 2), lambda x: x >= 0)
    tasks = _events(spark, sf_dir).select(F.col("event_id").alias("task_id"), status.alias("status"), (F.col("user_id") % 7).cast("int").alias("priority"), need.alias("dependencies"))
    return ledger.ready_tasks(tasks).select("task_id", "priority")


@C.query("SELECT user_id, bool_and(event_type IN ('purchase', 'signup', 'error')) AS done FROM events GROUP BY user_id")
def tasks_all_done(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "Completed").when(kind == "signup", "Skipped").when(kind == "error", "Failed").otherwise("Running")
    return ledger.all_done(_events(spark, sf_dir).withColumn("status", status), "user_id")


@C.query("SELECT user_id, sha256(string_agg(event_id || ':' || event_type, ';' ORDER BY CAST(event_id AS VARCHAR), event_type)) AS content_hash FROM events GROUP BY user_id")
def ledger_hash(spark, sf_dir):
    return ledger.content_hash(_events(spark, sf_dir), "user_id", "event_id", "event_type")


@C.query("""SELECT key, event_id FROM (SELECT user_id || ':' || event_type AS key, event_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 3600 * (event_id % 3) END AS ttl, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events), (SELECT max(ts) AS now FROM events)
WHERE n = 1 AND (ttl IS NULL OR epoch_us(now) - epoch_us(ts) < ttl * 1000000)""")
def cache_latest_ttl(spark, sf_dir):
    e = _events(spark, sf_dir)
    store = e.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", F.col("ts").alias("stored_at"), F.when(F.col("event_id") % 3 != 0, 3600 * (F.col("event_id") % 3)).alias("ttl_seconds"))
    now = e.agg(F.max("ts")).head()[0]
    return ledger.cached_results(store, F.lit(now).cast("timestamp_ntz")).select("key", "event_id")


@C.query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def lru_keep(spark, sf_dir):
    return ledger.most_recent_within(_events(spark, sf_dir), "ts", 100, "event_id").select("event_id")


@C.query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS pieces FROM conversations GROUP BY conv_id")
def token_stream_concat(spark, sf_dir):
    return ledger.joined_stream(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# -- budgets ---------------------------------------------------------------------------


def _use(spark, sf_dir):
    resource = F.when(F.col("event_type") == "view", "Tokens").when(F.col("event_type") == "click", "Steps").otherwise("ToolCalls")
    return _events(spark, sf_dir).select("event_id", "ts", "user_id", resource.alias("resource"), F.round("value", 2).cast("decimal(18,2)").alias("amount"))


USE = "used AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'Tokens' WHEN 'click' THEN 'Steps' ELSE 'ToolCalls' END AS resource, CAST(round(value, 2) AS DECIMAL(18, 2)) AS amount FROM events)"


@C.query(f"WITH {USE} SELECT event_id, CAST(sum(amount) OVER (PARTITION BY user_id, resource ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS consumed FROM used")
def budget_running(spark, sf_dir):
    return budget.running_use(_use(spark, sf_dir), "user_id", "resource", "amount", ORDER).select("event_id", F.col("consumed").cast("double").alias("consumed"))


def _budgets(spark, sf_dir):
    return _use(spark, sf_dir).groupBy("user_id", "resource").agg(F.sum("amount").cast("double").alias("consumed")).withColumn("allocated", F.when(F.col("resource") == "Tokens", 3000.0).when(F.col("resource") == "Steps", 1500.0).otherwise(0.0 + F.col("user_id") % 5 * 1000))


BUDGETS = f"{USE}, budgets AS (SELECT user_id, resource, CAST(sum(amount) AS DOUBLE) AS consumed, CASE resource WHEN 'Tokens' THEN 3000.0 WHEN 'Steps' THEN 1500.0 ELSE user_id % 5 * 1000.0 END AS allocated FROM used GROUP BY ALL), shares AS (SELECT *, CASE WHEN allocated > 0 THEN (allocated - consumed) / allocated ELSE 0 END AS share FROM budgets), levels AS (SELECT *, CASE WHEN share > 0.7 THEN 0 WHEN share > 0.3 THEN 1 WHEN share > 0.1 THEN 2 ELSE 3 END AS level FROM shares)"


@C.query(f"WITH {BUDGETS}, worst AS (SELECT user_id, max(level) AS level FROM levels GROUP BY user_id) SELECT user_id, level, ['Abundant', 'Normal', 'Scarce', 'Critical'][level + 1] AS scarcity, [1.0, 1.5, 3.0, 10.0][level + 1]::DOUBLE AS cost, [1.0, 0.8, 0.5, 0.2][level + 1]::DOUBLE AS appetite, CASE level WHEN 3 THEN 'blocked' WHEN 2 THEN 'warning' ELSE 'ok' END AS verdict FROM worst")
def budget_scarcity(spark, sf_dir):
    s = budget.overall_scarcity(_budgets(spark, sf_dir), "user_id")
    level = F.col("level")
    return s.select("user_id", "level", "scarcity", budget.multiplier(level).alias("cost"), budget.multiplier(level, budget.APPETITE).alias("appetite"), budget.can_proceed(level).alias("verdict"))


@C.query(f"WITH {BUDGETS}, short AS (SELECT user_id, resource, CASE resource WHEN 'Steps' THEN 1 WHEN 'Tokens' THEN 2 ELSE 4 END AS place, allocated - consumed < CASE resource WHEN 'Steps' THEN 1 WHEN 'Tokens' THEN 2000 ELSE 2 END AS lacks FROM budgets) SELECT user_id, coalesce(string_agg(resource, ',' ORDER BY place) FILTER (lacks), '') AS lacking, count(*) FILTER (lacks) = 0 AS granted FROM short GROUP BY user_id")
def budget_guard(spark, sf_dir):
    return budget.lacking(_budgets(spark, sf_dir), "user_id")


# -- beliefs ---------------------------------------------------------------------------

OUT = "outcomes AS (SELECT user_id % 5 AS agent, event_type AS category, value >= 50 AS success, least(greatest(value / 100, 0), 1) AS credit, event_id FROM events)"


@C.query(f"WITH {OUT} SELECT agent, category, CAST(2 + count(*) FILTER (success) AS DOUBLE) AS alpha, CAST(2 + count(*) FILTER (NOT success) AS DOUBLE) AS beta, count(*) AS observations FROM outcomes GROUP BY ALL")
def belief_binary(spark, sf_dir):
    return bandit.beliefs(outcomes(_events(spark, sf_dir)), "agent", "category", F.col("success"))


@C.query(f"WITH {OUT}, b AS (SELECT agent, category, 2 + sum(credit) AS a, 2 + sum(1 - credit) AS b FROM outcomes GROUP BY ALL) SELECT agent, category, round(a / (a + b), 6) AS mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 8) AS variance FROM b")
def belief_credit(spark, sf_dir):
    b = bandit.beliefs(outcomes(_events(spark, sf_dir)), "agent", "category", F.col("success"), F.col("credit"))
    return b.select("agent", "category", F.round(bandit.mean(F.col("alpha"), F.col("beta")), 6).alias("mean"), F.round(bandit.variance(F.col("alpha"), F.col("beta")), 8).alias("variance"))


@C.query(f"WITH {OUT} SELECT agent, category, count(*) AS observations FROM outcomes WHERE agent = 3 OR category = 'click' GROUP BY ALL")
def beliefs_of(spark, sf_dir):
    known = bandit.beliefs(outcomes(_events(spark, sf_dir)), "agent", "category", F.col("success"))
    return known.filter("agent = 3 OR category = 'click'").select("agent", "category", "observations")


def _candidates(spark):
    rows = [(f"r{i}", c, a, a) for i, c in enumerate(["view", "click", "purchase", "error", "signup", "unknown"]) for a in range(6)]
    return spark.createDataFrame(rows, "request string, category string, agent long, position int")


@C.query(f"""WITH {OUT}, b AS (SELECT agent, category, (2.0 + count(*) FILTER (success)) / (4.0 + count(*)) AS theta, count(*) AS n FROM outcomes GROUP BY ALL),
c AS (SELECT 'r' || i AS request, ['view', 'click', 'purchase', 'error', 'signup', 'unknown'][i + 1] AS category, a AS agent FROM range(6) r(i), range(6) s(a) WHERE a <> 1),
s AS (SELECT request, agent, coalesce(theta, 0.5) AS theta, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (agent, category))
SELECT request, agent, round(theta, 6) AS theta, round(least(1.0, n / 20), 6) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY request ORDER BY theta DESC, agent) = 1""")
def belief_rank(spark, sf_dir):
    known = bandit.beliefs(outcomes(_events(spark, sf_dir)), "agent", "category", F.col("success"))
    excluded = spark.createDataFrame([(f"r{i}", 1) for i in range(6)], "request string, agent long")
    return bandit.select(known, _candidates(spark), excluded).select("request", "agent", F.round("theta", 6).alias("theta"), F.round("confidence", 6).alias("confidence"))


def _gamma_sql(name, shape):
    u = lambda i, part: f"((('0x' || substr(md5(key || '|{name}{i}{part}'), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)"
    x = lambda i: f"(sqrt(-2 * ln({u(i, 'a')})) * cos(2 * pi() * {u(i, 'b')}))"
    tries = ", ".join(f"[{x(i)}, ln({u(i, 'c')})]" for i in range(bandit.PROPOSALS))
    return f"""(SELECT d * coalesce(list_filter(list_transform([{tries}], lambda p: CASE WHEN 1 + p[1] / sqrt(9 * d) > 0 AND
      p[2] < 0.5 * p[1] * p[1] + d - d * power(1 + p[1] / sqrt(9 * d), 3) + d * ln(greatest(power(1 + p[1] / sqrt(9 * d), 3), 1e-300)) THEN power(1 + p[1] / sqrt(9 * d), 3) END), lambda v: v IS NOT NULL)[1], 1.0)
      FROM (SELECT {shape} - 1.0::DOUBLE / 3 AS d))"""


@C.query(f"""WITH {OUT}, b AS (SELECT agent, category, 2.0::DOUBLE + count(*) FILTER (success) AS a, 2.0::DOUBLE + count(*) FILTER (NOT success) AS b, count(*) AS n FROM outcomes GROUP BY ALL),
c AS (SELECT 'r' || i AS request, ['view', 'click', 'purchase', 'error', 'signup', 'unknown'][i + 1] AS category, a AS agent, '17|r' || i || '|' || a AS key FROM range(6) r(i), range(6) s(a)),
k AS (SELECT request, agent, key, coalesce(b.a, 2.0) AS alpha, coalesce(b.b, 2.0) AS beta, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (agent, category)),
g AS (SELECT request, agent, n, {_gamma_sql("x", "alpha")} AS x, {_gamma_sql("y", "beta")} AS y FROM k)
SELECT request, agent, round(x / (x + y), 6) AS theta, round(least(1.0, n / 20), 6) AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY request ORDER BY x / (x + y) DESC, agent) = 1""")
def thompson_sample(spark, sf_dir):
    known = bandit.beliefs(outcomes(_events(spark, sf_dir)), "agent", "category", F.col("success"))
    return bandit.select(known, _candidates(spark), seed=17).select("request", "agent", F.round("theta", 6).alias("theta"), F.round("confidence", 6).alias("confidence"))


# -- intervals ---------------------------------------------------------------------------

LOG = """log AS (SELECT user_id AS assoc_id, CASE WHEN event_type = 'error' THEN 'retract' ELSE 'assert' END AS kind, ts, event_id FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
marked AS (SELECT *, lag(kind) OVER (PARTITION BY assoc_id ORDER BY ts, event_id) AS before FROM log),
opened AS (SELECT assoc_id, ts AS system_from, event_id FROM marked WHERE kind = 'assert' AND (before IS NULL OR before = 'retract')),
spans AS (SELECT o.assoc_id, o.system_from, (SELECT min(l.ts) FROM log l WHERE l.assoc_id = o.assoc_id AND l.kind = 'retract' AND l.ts > o.system_from) AS system_to FROM opened o),
latest AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY assoc_id ORDER BY system_from DESC) = 1)"""


def _replayed(spark, sf_dir, **options):
    return temporal.replay(assertions(_events(spark, sf_dir)), order=("event_id",), **options).select("assoc_id", "system_from", "system_to")


@C.query(f"WITH {LOG} SELECT * FROM latest")
def temporal_replay(spark, sf_dir):
    return _replayed(spark, sf_dir)


@C.query(f"WITH {LOG} SELECT * FROM spans")
def temporal_history(spark, sf_dir):
    return _replayed(spark, sf_dir, keep_history=True)


@C.query(f"WITH {LOG}, m AS (SELECT ts FROM events WHERE event_id = 400) SELECT assoc_id, system_from FROM spans, m WHERE system_from <= ts AND (system_to IS NULL OR system_to > ts)")
def as_of(spark, sf_dir):
    moment = _events(spark, sf_dir).filter("event_id = 400").head()["ts"]
    return temporal.as_of(_replayed(spark, sf_dir, keep_history=True), F.lit(moment).cast("timestamp_ntz")).select("assoc_id", "system_from")


@C.query(f"WITH {LOG}, m AS (SELECT ts FROM events) SELECT ts AS moment, (SELECT count(*) FROM spans WHERE system_from <= ts AND (system_to IS NULL OR system_to > ts)) AS open_rows FROM m")
def as_of_many(spark, sf_dir):
    moments = _events(spark, sf_dir).select(F.col("ts").alias("moment"))
    return temporal.as_of_many(_replayed(spark, sf_dir, keep_history=True), moments)


@C.query(f"WITH {LOG} SELECT assoc_id FROM latest WHERE system_to IS NULL")
def currently_asserted(spark, sf_dir):
    return temporal.current(_replayed(spark, sf_dir)).select("assoc_id")


@C.query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, o_orderdate + INTERVAL 30 DAY AS valid_to FROM orders)
SELECT o_orderkey FROM (SELECT o_orderkey, valid_from, max(valid_to) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_to, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v) WHERE reach > valid_from""")
def valid_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_to"))
    return temporal.overlapping(rows, ["o_custkey"], order=("o_orderkey",)).select("o_orderkey")


@C.query("""SELECT user_id, arg_max(event_id, (event_type = 'error', event_id)) AS event_id, arg_max(event_type, (event_type = 'error', event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def keyed_upserts(spark, sf_dir):
    """The last event of each user, errors written over others; the first batch comes twice and counts once."""
    e = _events(spark, sf_dir).filter("user_id IS NOT NULL").select("user_id", "event_id", "event_type")
    held = keyed.KeyedTable(spark, shared_folder(spark), e.schema, ["user_id"])
    for batch, rows in (("plain", e.filter("event_type <> 'error'")), ("errors", e.filter("event_type = 'error'")), ("plain", e.filter("event_type <> 'error'"))):
        held.upsert(rows, ["event_id"], batch=batch)
    return held.read()


@C.query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate AS valid_from, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'P' THEN o_orderdate + INTERVAL 300 DAY ELSE o_orderdate + INTERVAL 20 DAY END AS valid_to FROM orders)
SELECT a.o_custkey, a.o_orderkey AS first_id, b.o_orderkey AS second_id, b.valid_from AS overlap_from, CASE WHEN a.valid_to IS NULL THEN b.valid_to WHEN b.valid_to IS NULL THEN a.valid_to ELSE least(a.valid_to, b.valid_to) END AS overlap_to
FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND b.valid_from >= a.valid_from AND (a.valid_to IS NULL OR b.valid_from < a.valid_to) AND (b.valid_from > a.valid_from OR b.o_orderkey > a.o_orderkey) AND a.o_orderkey <> b.o_orderkey""")
def conflicting_pairs(spark, sf_dir):
    days = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    until = F.when(F.col("o_orderstatus") == "P", days(300)).when(F.col("o_orderstatus") != "O", days(20))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), until.alias("valid_to"))
    return temporal.conflicts(rows, ["o_custkey"], "o_orderkey")


@C.query("""SELECT CAST(event_id AS VARCHAR) AS subject, 'wasGeneratedBy' AS relation, event_type AS object FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 'wasAttributedTo', CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 = 0
UNION ALL SELECT event_type, 'wasAssociatedWith', CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 = 0""")
def provenance(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("agent", F.when(F.col("user_id") % 2 == 0, F.col("user_id")))
    return temporal.provenance(rows, "event_id", "event_type", "agent")
