"""Streams of events: per-key state, windows with watermarks, and de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "alpha double, beta double, events long, last_id long, last_type string"
OUT = "user_id long, " + STATE


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream; times without a zone become UTC timestamps, as watermarks need them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    a, b, n, last, kind = state.get if state.exists else (2.0, 2.0, 0, -1, "")
    for rows in batches:
        good = rows["event_type"].isin(["purchase", "signup"])
        a, b, n = a + float(good.sum()), b + float((~good).sum()), n + len(rows)
        top = rows.loc[rows["event_id"].idxmax()]
        if int(top["event_id"]) > last:
            last, kind = int(top["event_id"]), str(top["event_type"])
    state.update((a, b, n, last, kind))
    yield pd.DataFrame([(key[0], a, b, n, last, kind)], columns=["user_id", "alpha", "beta", "events", "last_id", "last_type"])


def running_beliefs(events: DataFrame) -> DataFrame:
    """A belief and the last event of each user, updated with every batch.

    The sums do not depend on order, and the last event is that with the highest id, so
    the result after all batches equals the batch fold whatever the order of arrival.
    """
    return events.groupBy("user_id").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def batch_beliefs(events: DataFrame) -> DataFrame:
    """The same fold over a finished table."""
    good = F.col("event_type").isin("purchase", "signup")
    return events.groupBy("user_id").agg((2.0 + F.count_if(good)).alias("alpha"), (2.0 + F.count_if(~good)).alias("beta"), F.count("*").alias("events"), F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in fixed windows; for streams, rows later than the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events without a pause of ``gap``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


DEADLINES = "workflow_id long, step string, event_id long, timed_out boolean"


def _race(limit_s: float):
    """Phases of one workflow against their time limit: the timer counts only if the phase has not moved on."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            phase, last, _ = state.get
            out.append((key[0], phase, last, True))
            state.remove()
        else:
            phase, last, at = state.get if state.exists else ("", -1, 0)
            for rows in batches:
                for r in rows.sort_values(["ts", "event_id"]).itertuples():
                    now = int(r.ts.value // 1000)
                    if last >= 0:
                        out.append((key[0], phase, last, now - at > limit_s * 1_000_000))
                    phase, last, at = str(r.event_type), int(r.event_id), now
            state.update((phase, last, at))
            # A deadline that the watermark has passed already fires with the next batch.
            state.setTimeoutTimestamp(max(at // 1000 + int(limit_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["workflow_id", "step", "event_id", "timed_out"])

    return step


def phase_timers(events: DataFrame, limit_s: float, late: str = "10 minutes") -> DataFrame:
    """Whether each phase (event) of a workflow (user) ran over its limit, told once.

    A phase is over with the next event; else when the watermark passes its deadline. Events
    have to come in order of time within a workflow, or in the same batch.
    """
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(_race(limit_s), DEADLINES, "phase string, last long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def changes(spark: SparkSession, path: str, schema: str = "position long, op string, domain string, type string, body string") -> DataFrame:
    """A live subscription to edits of a model: JSON files as a stream, in the schema of the edit log."""
    return spark.readStream.schema(schema).json(path)


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once: state for duplicates is dropped when the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Drives a stream over all input there is, into a table in memory (for small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
