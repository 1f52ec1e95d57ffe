"""Metrics of a query, counted while it runs: no second job, no cached step."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .objectset import ObjectSet


@dataclass
class Trace:
    """Named points of a plan with what was counted there. Values are there once an action has run."""

    points: list[tuple[str, Observation]] = field(default_factory=list)
    seconds: float | None = None

    def at(self, rows: DataFrame, name: str, **counts: Column) -> DataFrame:
        """``rows`` as they are; counts them, and what ``counts`` aggregates, as they pass."""
        if any(n == name for n, _ in self.points):
            raise ValueError(f"point {name} exists")
        seen = Observation()
        self.points.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items()))

    def run(self, rows: DataFrame) -> None:
        """Runs a plan for its counts alone, and takes the time."""
        began = time.perf_counter()
        rows.write.format("noop").mode("overwrite").save()
        self.seconds = time.perf_counter() - began

    def values(self) -> dict[str, dict]:
        """What was counted at each point. Waits for the first action over the plan."""
        return {name: dict(seen.get) for name, seen in self.points}


def observed_walk(start: ObjectSet, links: list[str], trace: Trace | None = None) -> tuple[ObjectSet, Trace]:
    """The objects that ``links`` lead to, and a trace with the objects of each hop.

    The plan stays one: counts are kept by the tasks that produce a hop's rows. They are
    telemetry: a stage that runs again after a lost executor may count its rows again.
    """
    trace = trace or Trace()
    now = replace(start, df=trace.at(start.df, f"0 {start.of.name}"))
    for i, link in enumerate(links, 1):
        now = now.traverse(link)
        now = replace(now, df=trace.at(now.df, f"{i} {link}"))
    return now, trace
