"""Ledgers of tasks and progress, cached results, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A task in one of these states is done.
FINAL = ("Completed", "Skipped", "Failed")


def recent(entries: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """The last ``n`` entries of each key, with ``place`` from 1 for the latest."""
    if n <= 0:
        raise ValueError("n is positive")
    by = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return entries.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)


def progress_metrics(entries: DataFrame, key: str, tokens: Column, duration: Column, artifacts: Column, signal: Column) -> DataFrame:
    """Entries, tokens, duration (nulls aside), distinct artifacts, success and failure signals of each key."""
    rows = entries.select(F.col(key), tokens.alias("_t"), duration.alias("_d"), artifacts.alias("_a"), signal.alias("_s"))
    totals = rows.groupBy(key).agg(F.count("*").alias("entries"), F.sum("_t").alias("tokens"), F.sum("_d").alias("duration"), F.count_if(F.col("_s") == "Success").alias("successes"), F.count_if(F.col("_s") == "Failure").alias("failures"))
    distinct = rows.select(key, F.explode("_a").alias("_x")).groupBy(key).agg(F.count_distinct("_x").alias("artifacts"))
    return totals.join(distinct, key, "left").withColumn("artifacts", F.coalesce("artifacts", F.lit(0).cast("long")))


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are completed, the most urgent first.

    Columns task_id, status, priority, dependencies. An unknown dependency is not
    completed.
    """
    needs = tasks.filter("status = 'Pending'").select(F.col("task_id").alias("waiting"), F.explode("dependencies").alias("need"))
    done = tasks.filter("status = 'Completed'").select(F.col("task_id").alias("need"))
    blocked = needs.join(done, "need", "left_anti").select(F.col("waiting").alias("task_id")).distinct()
    return tasks.filter("status = 'Pending'").join(blocked, "task_id", "left_anti").orderBy(F.col("priority").desc(), "task_id")


def all_done(tasks: DataFrame, key: str) -> DataFrame:
    return tasks.groupBy(key).agg(F.every(F.col("status").isin(*FINAL)).alias("done"))


def latest_versions(log: DataFrame, key: str, version: str, tie: str | None = None) -> DataFrame:
    """The current row of each key in an append-only log: that of the greatest version.

    Of rows of one version, the greatest by ``tie`` counts, or else by all columns in turn
    (those of types that have no order aside), so that a rerun gives the same row.
    """
    rest = [c for c, t in log.dtypes if c not in (key, version) and not t.startswith(("map", "variant"))] if tie is None else [tie]
    order = Window.partitionBy(key).orderBy(F.col(version).desc(), *(F.col(c).desc() for c in rest))
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def content_hash(tasks: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """A hash of each ledger's tasks that does not depend on their order in the table."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(id_col).cast("string"), F.col(text_col).cast("string"))))
    return tasks.groupBy(key).agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["col1"], r["col2"])), ";"), 256).alias("content_hash"))


def after(entries: DataFrame, time_col: str, moment: Column) -> DataFrame:
    return entries.filter(F.col(time_col) > moment)


def input_hash(*columns: str) -> Column:
    """A key for a step's cached result."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def cached_results(store: DataFrame, now: Column, key: str = "key", stored_col: str = "stored_at", ttl_col: str = "ttl_seconds") -> DataFrame:
    """The latest result of each key; a null time to live never expires, an expired latest result is a miss."""
    last = latest_versions(store, key, stored_col)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(stored_col).cast("timestamp"))
    return last.filter(F.col(ttl_col).isNull() | (age < F.col(ttl_col) * 1_000_000))


def most_recent_within(store: DataFrame, used_col: str, capacity: int, id_col: str) -> DataFrame:
    """What a least-recently-used store of that capacity still holds.

    The boundary is found by an ordered limit, which Spark keeps to ``capacity`` rows a task.
    """
    return store.orderBy(F.col(used_col).desc(), F.col(id_col).desc()).limit(capacity)


def joined_stream(tokens: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """A stream of text pieces put together in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return tokens.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("content"), F.count("*").alias("pieces"))
