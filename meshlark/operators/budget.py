"""Budgets of workflows: running use, scarcity and guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Default budget, levels of scarcity, and the two tables of multipliers.
DEFAULTS = {"Steps": 25.0, "Tokens": 50_000.0, "Executions": 15.0, "ToolCalls": 40.0, "WallTime": 300.0}
LEVELS = ("Abundant", "Normal", "Scarce", "Critical")
COST_MULTIPLIER = {"Abundant": 1.0, "Normal": 1.5, "Scarce": 3.0, "Critical": 10.0}
APPETITE = {"Abundant": 1.0, "Normal": 0.8, "Scarce": 0.5, "Critical": 0.2}
RESERVATION = {"Steps": 1.0, "Tokens": 2000.0, "Executions": 1.0, "ToolCalls": 2.0}


@dataclass(frozen=True)
class BudgetOptions:
    """How budgets are estimated and allotted; the cost multipliers may not fall as a budget runs out."""

    steps_per_complexity: int = 5
    tokens_per_step: int = 2000
    execution_ratio: float = 0.6
    tool_call_ratio: float = 1.5
    retry_margin: float = 0.2
    defaults: tuple[float, ...] = tuple(DEFAULTS.values())
    multipliers: tuple[float, ...] = tuple(COST_MULTIPLIER.values())

    def __post_init__(self):
        if self.defaults[0] <= 0 or self.defaults[1] <= 0 or self.defaults[4] <= 0:
            raise ValueError("steps, tokens and wall time are positive")
        if list(self.multipliers) != sorted(self.multipliers):
            raise ValueError("multipliers rise with scarcity")

    def allotted(self) -> dict[str, float]:
        return dict(zip(DEFAULTS, self.defaults, strict=True))

    def multiplier(self, level: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.multipliers)), level)

    def estimate(self, complexity: Column) -> dict[str, Column]:
        """Steps, tokens, executions and tool calls of a task by its complexity, with the margin for retries."""
        steps = F.ceil(complexity * self.steps_per_complexity * (1 + self.retry_margin))
        return {"Steps": steps, "Tokens": steps * self.tokens_per_step, "Executions": F.ceil(steps * self.execution_ratio), "ToolCalls": F.ceil(steps * self.tool_call_ratio)}


def usage_totals(usage: DataFrame, key: str, columns: tuple[str, ...] = ("tokens", "executions", "tool_calls", "duration")) -> DataFrame:
    """The sum of each part of a key's usage; parts that are null add nothing, a key without any has 0."""
    return usage.groupBy(key).agg(*(F.coalesce(F.sum(c), F.lit(0).cast(usage.schema[c].dataType)).alias(c) for c in columns))


def remaining_share(allocated: Column, consumed: Column) -> Column:
    """Share of a budget that is left; 0 where nothing was allocated."""
    return F.when(allocated > 0, F.try_divide(allocated - consumed, allocated)).otherwise(0.0)


def scarcity_level(share: Column) -> Column:
    """0 abundant (over 0.7), 1 normal (over 0.3), 2 scarce (over 0.1), 3 critical."""
    return F.when(share > 0.7, 0).when(share > 0.3, 1).when(share > 0.1, 2).otherwise(3)


def level_name(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), level)


def multiplier(level: Column, table: dict[str, float] = COST_MULTIPLIER) -> Column:
    return F.get(F.array(*(F.lit(table[x]) for x in LEVELS)), level)


def running_use(log: DataFrame, key: str, resource: str, amount: str, order: list[str]) -> DataFrame:
    """Adds ``consumed``: what the key has used of the resource up to and with each entry."""
    by = Window.partitionBy(key, resource).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("consumed", F.sum(amount).over(by))


def overall_scarcity(budgets: DataFrame, key: str) -> DataFrame:
    """The worst level over a key's resources (columns allocated, consumed)."""
    level = scarcity_level(remaining_share(F.col("allocated"), F.col("consumed")))
    return budgets.groupBy(key).agg(F.max(level).alias("level")).withColumn("scarcity", level_name(F.col("level")))


def can_proceed(level: Column) -> Column:
    """ok, warning when scarce, blocked when critical; no budget is ok."""
    return F.when(level == 3, "blocked").when(level == 2, "warning").otherwise("ok")


def lacking(budgets: DataFrame, key: str, request: dict[str, float] | None = None) -> DataFrame:
    """For each key the requested resources of which too little is left, in the fixed order, comma-joined."""
    request = RESERVATION if request is None else request
    order = list(DEFAULTS)
    want = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in request.items() for x in (k, float(v)))), F.col("resource")), F.lit(0.0))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("resource"))
    short = F.when((want > 0) & (F.col("allocated") - F.col("consumed") < want), F.struct(place.alias("place"), F.col("resource").alias("resource")))
    rows = budgets.groupBy(key).agg(F.array_sort(F.collect_list(short)).alias("_short"))
    return rows.select(key, F.array_join(F.transform("_short", lambda s: s["resource"]), ",").alias("lacking"), (F.size("_short") == 0).alias("granted"))
