"""What a workflow's log says to its auditors: guarded starts, audit events, typed library events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALIDATION_FAILED = "ValidationFailed"


@dataclass
class Conditions:
    """Conditions by id: functions from the rows' columns to a boolean column. A later one of an id takes its place."""

    by_id: dict[str, Callable[[], Column]] = field(default_factory=dict)

    def register(self, condition_id: str, condition: Callable[[], Column]) -> None:
        if not condition_id or condition is None:
            raise ValueError("a condition needs an id and a function")
        self.by_id[condition_id] = condition

    def __contains__(self, condition_id: str) -> bool:
        return condition_id in self.by_id

    def evaluate(self, condition_id: str) -> Column:
        """The condition as a column; null counts as false."""
        if condition_id not in self.by_id:
            raise LookupError(f"condition {condition_id} is not registered")
        return F.coalesce(self.by_id[condition_id]().cast("boolean"), F.lit(False))


def start_steps(requests: DataFrame, steps: DataFrame, conditions: Conditions, step: str = "step", at: str = "ts") -> DataFrame:
    """Requests to start steps, judged by the steps' guards.

    ``steps`` has step, validate (id of a condition, or empty), message and timeout_s.
    Adds ``phase`` (the step, or ValidationFailed), ``event`` (Dispatched or
    ValidationFailed), ``error`` and ``deadline`` (null without a limit or a dispatch).
    Steps that the table lacks have no guard.
    """
    rules = steps.select(F.col("step").alias("_step"), F.col("validate").alias("_validate"), F.col("message").alias("_message"), F.col("timeout_s").alias("_limit"))
    rows = requests.join(F.broadcast(rules), F.col(step) == F.col("_step"), "left")  # a definition's steps
    holds = F.lit(True)
    for name in {r[0] for r in steps.select("validate").distinct().collect() if r[0]}:
        holds = F.when(F.col("_validate") == name, conditions.evaluate(name)).otherwise(holds)
    rows = rows.withColumn("_holds", holds)
    deadline = F.when(F.col("_holds"), F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + (F.col("_limit") * 1_000_000).cast("long")))
    return rows.select(
        *requests.columns, F.when(F.col("_holds"), F.col(step)).otherwise(VALIDATION_FAILED).alias("phase"), F.when(F.col("_holds"), "Dispatched").otherwise(VALIDATION_FAILED).alias("event"),
        F.when(~F.col("_holds"), F.col("_message")).alias("error"), deadline.alias("deadline"),
    )


def audit_events(log: DataFrame, steps: DataFrame, key: str, order: list[str], step: str = "step", ok: str = "ok", confidence: str = "confidence") -> DataFrame:
    """The audit trail of step logs: key, order columns, place, event, step, detail.

    Started with a key's first entry; StepCompleted or StepFailed for each; LowConfidenceRouted
    (detail: where to) after a completed step below its least confidence; Failed after a
    key's first failure; Completed after the last entry of a key without failures.
    """
    rules = steps.select(F.col("step").alias("_step"), "least_confidence", "on_low_confidence")
    by = Window.partitionBy(key).orderBy(*order)
    bad = F.when(F.col(ok), 0).otherwise(1)
    rows = log.withColumn("_n", F.row_number().over(by)).withColumn("_bad", F.sum(bad).over(by)).withColumn("_after", F.lead(F.lit(1)).over(by)).join(F.broadcast(rules), F.col(step) == F.col("_step"), "left")
    low = F.col(ok) & F.coalesce(F.col(confidence) < F.col("least_confidence"), F.lit(False))
    event = lambda when, place, name, detail: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(name).alias("event"), detail.cast("string").alias("detail")))
    none = F.lit(None)
    all_ = F.array(
        event(F.col("_n") == 1, 0, "Started", none),
        event(F.col(ok), 1, "StepCompleted", F.round(confidence, 6)),
        event(~F.col(ok), 1, "StepFailed", none),
        event(low, 2, "LowConfidenceRouted", F.col("on_low_confidence")),
        event(~F.col(ok) & (F.col("_bad") == 1), 3, "Failed", F.col(step)),
        event(F.col("_after").isNull() & (F.col("_bad") == 0), 3, "Completed", none),
    )
    return rows.select(key, *order, F.col(step).alias("step"), F.explode(F.array_compact(all_)).alias("_e")).select(key, *order, "_e.place", "_e.event", "step", "_e.detail")


def _fields(text: str) -> str:
    return f"workflow_id string, {text}, timestamp timestamp"


#: The library's events and their fields. Durations are in seconds.
LIBRARY_EVENTS = {
    "WorkflowStarted": _fields("original_request string"),
    "WorkflowCompleted": _fields("outcome string, final_answer string, total_duration double"),
    "TaskPlanned": _fields("task_id string, description string, priority int, dependencies array<string>"),
    "TaskCompleted": _fields("task_id string, final_status string, result string"),
    "ExecutionStarted": _fields("task_id string, executor_id string"),
    "ExecutionCompleted": _fields("task_id string, executor_id string, result string, confidence double, duration double"),
    "ExecutionFailed": _fields("task_id string, executor_id string, reason string, is_recoverable boolean, duration double"),
    "LoopDetected": _fields("loop_type string, confidence double, recommended_strategy string"),
    "RecoveryStrategyApplied": _fields("strategy string, loop_type string, action_taken string"),
}


def library_events(rows: DataFrame, kind: str, kind_col: str = "event", payload_col: str = "payload") -> DataFrame:
    """The events of one kind of a mixed JSON log, as typed columns; an unreadable payload has nulls."""
    if kind not in LIBRARY_EVENTS:
        raise LookupError(f"unknown event {kind}")
    return rows.filter(F.col(kind_col) == kind).select(F.from_json(payload_col, LIBRARY_EVENTS[kind]).alias("_e")).select("_e.*")


def json_field(document: str, name: str, kind: str = "string") -> Column:
    """A field of rows that are stored as JSON, as ``kind``; null if it is missing or of another form."""
    return F.get_json_object(document, f"$['{name}']").try_cast(kind)
