"""Workflow definitions, and folds of event logs into states.

Spark does not run workflows here: it derives from their logs where each one stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, DONE, FAILED = "NotStarted", "Completed", "Failed"
#: Phases in which a path of a fork is over.
OVER = ("Success", "Failed", "FailedWithRecovery")


@dataclass(frozen=True)
class Step:
    """A step: what follows it, and the options that its log entries are judged by."""

    name: str
    kind: str = "step"  # step, branch, loop, fork, join, approval
    least_confidence: float | None = None
    on_low_confidence: str = ""
    compensate: str = ""
    retries: int = 0
    timeout_s: float | None = None
    max_rounds: int = 0
    validate: str = ""  # id of a condition that must hold before it starts
    message: str = ""
    context: tuple[str, ...] = ()  # names of the segments that its prompt is put together from


@dataclass(frozen=True)
class Workflow:
    """A definition: steps and transitions (from, to, case). Every method returns a new definition."""

    name: str
    steps: tuple[Step, ...] = ()
    moves: tuple[tuple[str, str, str], ...] = ()
    open_ends: tuple[tuple[str, str], ...] = ((START, ""),)
    failure: tuple[str, ...] = ()
    forks: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _add(self, step: Step, ends: Iterable[tuple[str, str]] | None = None) -> Workflow:
        if any(s.name == step.name for s in self.steps):
            raise ValueError(f"step {step.name} exists")
        moves = tuple((a, step.name, case) for a, case in self.open_ends)
        return replace(self, steps=(*self.steps, step), moves=self.moves + moves, open_ends=tuple(ends or ((step.name, ""),)))

    def then(self, name: str, **options) -> Workflow:
        return self._add(Step(name, **options))

    def branch(self, name: str, cases: dict[str, list[str]], default: list[str] | None = None) -> Workflow:
        """A choice by value; the ends of all cases meet at the next step."""
        out, ends = self._add(Step(name, "branch")), []
        for case, names in {**cases, **({"*": default} if default is not None else {})}.items():
            now = replace(out, open_ends=((name, case),))
            for n in names:
                now = now.then(n)
            ends += now.open_ends
            out = replace(now, open_ends=())
        return replace(out, open_ends=tuple(ends))

    def repeat(self, name: str, body: list[str], max_rounds: int) -> Workflow:
        """A loop: ``name`` decides after each round; case ``again`` goes back, case ``done`` goes on."""
        if max_rounds < 1 or not body:
            raise ValueError("a loop has at least one round and one step")
        out = self
        for n in body:
            out = out.then(n)
        out = out._add(Step(name, "loop", max_rounds=max_rounds), ((name, "done"),))
        return replace(out, moves=(*out.moves, (name, body[0], "again")))

    def fork(self, name: str, paths: dict[str, list[str]], join: str) -> Workflow:
        if len(paths) < 2 or not all(paths.values()):
            raise ValueError("a fork has at least two paths of at least one step")
        out, ends = self._add(Step(name, "fork")), []
        for path, names in paths.items():
            now = replace(out, open_ends=((name, path),))
            for n in names:
                now = now.then(n)
            ends += now.open_ends
            out = replace(now, open_ends=())
        return replace(out, open_ends=tuple(ends), forks={**out.forks, name: tuple(paths)})._add(Step(join, "join"))

    def approval(self, name: str, rejected: str = FAILED, timeout_s: float | None = None) -> Workflow:
        out = self._add(Step(name, "approval", timeout_s=timeout_s), ((name, "approved"),))
        return replace(out, moves=(*out.moves, (name, rejected, "rejected")))

    def on_failure(self, *names: str) -> Workflow:
        return replace(self, failure=names)

    def finish(self) -> Workflow:
        moves = tuple((a, DONE, case) for a, case in self.open_ends)
        chain = [FAILED, *self.failure]
        recover = tuple((a, b, "recover") for a, b in zip(chain, chain[1:], strict=False))
        failing = tuple((s.name, FAILED, "failed") for s in self.steps)
        return replace(self, moves=tuple(dict.fromkeys(self.moves + moves + failing + recover)), open_ends=())

    # -- tables and exports --------------------------------------------------------

    def transitions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, *m) for m in self.moves], "workflow string, phase_from string, phase_to string, case string")

    def step_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, s.name, s.kind, s.least_confidence, s.on_low_confidence, s.compensate, s.retries, s.timeout_s, s.max_rounds, s.validate, s.message, list(s.context)) for s in self.steps]
        return spark.createDataFrame(rows, "workflow string, step string, kind string, least_confidence double, on_low_confidence string, compensate string, retries int, timeout_s double, max_rounds int, validate string, message string, context array<string>")

    def to_json(self) -> str:
        return json.dumps({"version": "1.0", "name": self.name, "steps": [s.__dict__ for s in self.steps], "moves": self.moves, "failure": self.failure, "forks": self.forks})

    @staticmethod
    def from_json(text: str) -> Workflow:
        d = json.loads(text)
        if d.get("version") != "1.0":
            raise ValueError(f"unknown version {d.get('version')}")
        return Workflow(d["name"], tuple(Step(**{**s, "context": tuple(s.get("context", ()))}) for s in d["steps"]), tuple(map(tuple, d["moves"])), (), tuple(d["failure"]), {k: tuple(v) for k, v in d["forks"].items()})

    def diagram(self) -> str:
        """A Mermaid state diagram of the transitions."""
        mark = lambda s: "[*]" if s in (START, DONE) else s
        return "\n".join(["stateDiagram-v2", *(f"    {mark(a)} --> {mark(b)}" + (f" : {case}" if case else "") for a, b, case in self.moves)])


def illegal_moves(log: DataFrame, transitions: DataFrame, key: str, order: list[str], phase: str) -> DataFrame:
    """Log entries whose phase cannot follow the one before: key, order columns, phase_from, phase_to."""
    by = Window.partitionBy(key).orderBy(*order)
    moves = log.select(key, *order, F.coalesce(F.lag(phase).over(by), F.lit(START)).alias("phase_from"), F.col(phase).alias("phase_to"))
    return moves.join(F.broadcast(transitions.select("phase_from", "phase_to").distinct()), ["phase_from", "phase_to"], "left_anti")  # a definition's moves


def fold_states(log: DataFrame, key: str, order: list[str], replaced: list[str], appended: list[str] = (), merged: list[str] = ()) -> DataFrame:
    """The state of each key after its events.

    ``replaced``: the last value that is not null. ``appended``: all values in order.
    ``merged``: maps put over each other, later keys win.
    """
    at = F.struct(*order)
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in replaced]
    for c in appended:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))), lambda e: e["v"]).alias(c))
    for c in merged:
        # Maps have no order of their own: sorted by place only.
        by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
        pairs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))), by_place)
        put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(e["v"]), k)), e["v"])
        aggs.append(F.aggregate(pairs, F.create_map().cast(log.schema[c].dataType), put).alias(c))
    return log.groupBy(key).agg(*aggs, F.count("*").alias("events"))


def confidence_gate(log: DataFrame, steps: DataFrame, step: str = "step", confidence: str = "confidence") -> DataFrame:
    """Adds ``route``: the low-confidence handler where a confidence lies below the step's least, else ``next``."""
    rules = steps.select(F.col("step").alias("_step"), "least_confidence", "on_low_confidence")
    low = F.coalesce(F.col(confidence) < F.col("least_confidence"), F.lit(False))
    return log.join(F.broadcast(rules), log[step] == F.col("_step"), "left").withColumn("route", F.when(low, F.col("on_low_confidence")).otherwise("next")).drop("_step", "least_confidence", "on_low_confidence")


def fork_status(paths: DataFrame, keys: list[str], expected: int, status: str = "status") -> DataFrame:
    """For each fork: whether all paths are over (ready), all succeeded, any failed, any recovered."""
    over = F.col(status).isin(*OVER)
    return paths.groupBy(*keys).agg(
        (F.count_if(over) == expected).alias("ready"), F.every(F.col(status) == "Success").alias("all_succeeded"), F.some(F.col(status) == "Failed").alias("any_failed"), F.some(F.col(status) == "FailedWithRecovery").alias("any_recovered")
    )


def branch_route(rows: DataFrame, transitions: DataFrame, branch: str, value: Column) -> DataFrame:
    """Adds ``next``: the step that the value's case, or the default, leads to; null if none fits."""
    cases = transitions.filter((F.col("phase_from") == branch) & (F.col("case") != "failed"))
    exact = cases.select(F.col("case").alias("_case"), F.col("phase_to").alias("_to"))
    other = cases.filter("case = '*'").select(F.first("phase_to").alias("_default"))
    return rows.withColumn("_case", value).join(F.broadcast(exact), "_case", "left").join(F.broadcast(other)).withColumn("next", F.coalesce("_to", "_default")).drop("_case", "_to", "_default")


def loop_rounds(log: DataFrame, key: str, loop_step: str, max_rounds: int, order: list[str], step: str = "step", again: str = "again") -> DataFrame:
    """Rounds of a loop by key, whether the bound was hit, and whether it goes on."""
    at = log.filter(F.col(step) == loop_step)
    return at.groupBy(key).agg(F.count("*").alias("rounds"), F.max_by(again, F.struct(*order)).alias("_again")).select(key, "rounds", (F.col("rounds") >= max_rounds).alias("exhausted"), (F.col("_again") & (F.col("rounds") < max_rounds)).alias("goes_on"))


def compensations(log: DataFrame, steps: DataFrame, key: str, order: list[str], step: str = "step", ok: str = "ok") -> DataFrame:
    """Rollbacks of failed workflows: the completed steps' compensations, latest first, then the failure."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = log.withColumn("_failed", F.max((~F.col(ok)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_any", F.max((~F.col(ok)).cast("int")).over(Window.partitionBy(key)))
    undo = marked.filter((F.col("_any") == 1) & F.col(ok) & (F.coalesce("_failed", F.lit(0)) == 0)).join(F.broadcast(steps.select(F.col("step").alias("_s"), "compensate")), F.col(step) == F.col("_s")).filter("compensate <> ''")
    return undo.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))).select(key, "place", "compensate")


def timeouts(log: DataFrame, key: str, order: list[str], time_col: str, limit_s: Column, now: Column) -> DataFrame:
    """Adds ``timed_out``: the next entry of the key came, or now is, later than the limit."""
    after = F.coalesce(F.lead(time_col).over(Window.partitionBy(key).orderBy(*order)), now)
    late = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(time_col).cast("timestamp"))) > limit_s.cast("long") * 1_000_000
    return log.withColumn("timed_out", F.coalesce(late, F.lit(False)))


def permitted_forks(requests: DataFrame, triggers: DataFrame, max_forks: int, key: str, order: list[str]) -> DataFrame:
    """Diagnostic forks: adds ``granted`` for known triggers with all evidence filled in, up to a number by key.

    ``requests``: trigger, evidence (map). ``triggers``: trigger, fields (array).
    """
    rows = requests.join(F.broadcast(triggers), "trigger", "left")
    full = F.coalesce(F.forall("fields", lambda f: F.length(F.trim(F.coalesce(F.try_element_at("evidence", f), F.lit("")))) > 0), F.lit(False))
    rows = rows.withColumn("_ok", full)
    n = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("granted", F.col("_ok") & (n <= max_forks)).drop("_ok", "fields")


def step_telemetry(log: DataFrame, step: str, ok: Column, duration: Column) -> DataFrame:
    """Completed and failed entries of each step, and its durations: mean, median and 95th percentile."""
    parts = F.percentile(duration, [0.5, 0.95])
    rows = log.groupBy(step).agg(F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.round(F.avg(duration), 6).alias("mean_duration"), parts.alias("_p"))
    return rows.select(step, "completed", "failed", "mean_duration", F.round(F.get("_p", F.lit(0)), 6).alias("median_duration"), F.round(F.get("_p", F.lit(1)), 6).alias("p95_duration"))


def catalog_resolve(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact matches on (workflow_id, version); the first entry wins, a miss has a null definition."""
    first = catalog.groupBy("workflow_id", "version").agg(F.min_by("definition", "position").alias("definition"))
    return wanted.join(first, ["workflow_id", "version"], "left")


def assemble_context(segments: DataFrame, key: str) -> DataFrame:
    """One prompt a key: parts in order of ``place``, blank lines between; items of one part by ``item``, a rule between."""
    parts = segments.groupBy(key, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "content"))), lambda s: s["content"]), "\n---\n").alias("content"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), "\n\n").alias("prompt"))


def within_budget(found: DataFrame, key: str, rank: str, tokens: Column, budget: int) -> DataFrame:
    """Of each key's records the first ones, by rank, that fit a budget of tokens together; ``used`` is their running sum.

    The first record that does not fit ends the list, also if a later one would.
    """
    used = F.sum(tokens).over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("used", used).filter(F.col("used") <= budget)


def retrieved_segments(found: DataFrame, key: str, rank: str, content: str, place: int) -> DataFrame:
    """Retrieved records as segments of a context, in order of their ranks: key, place, item, content."""
    return found.select(key, F.lit(place).alias("place"), F.col(rank).cast("long").alias("item"), F.col(content).alias("content"))
