"""Joins of parallel paths as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workflow import OVER


def fork_joins(paths: DataFrame, expected: int, span: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """For each fork whether all paths are over (ready), all succeeded, any failed, any recovered.

    ``paths``: fork_id, path (0 .. expected - 1), status, ts; one row for each path, path 0
    being the one that opens the fork. The paths' streams are joined by fork within ``span``
    of path 0. A fork is told once: as soon as all its paths are there, or when the watermark
    has passed ``span``, so that no missing path can still come. Equals ``fork_status``.
    """
    sides = [paths.filter(F.col("path") == i).select(F.col("fork_id").alias(f"f{i}"), F.col("status").alias(f"s{i}"), F.col("ts").alias(f"t{i}")).withWatermark(f"t{i}", late) for i in range(expected)]
    out = sides[0]
    for i in range(1, expected):
        within = F.expr(f"f0 = f{i} AND t{i} >= t0 - INTERVAL {span} AND t{i} <= t0 + INTERVAL {span}")
        out = out.join(sides[i], within, "left_outer")
    of = lambda test: [F.coalesce(test(F.col(f"s{i}")), F.lit(False)) for i in range(expected)]
    every = lambda cols: reduce(lambda a, b: a & b, cols)
    some = lambda cols: reduce(lambda a, b: a | b, cols)
    succeeded = [F.col(f"s{i}").isNull() | (F.col(f"s{i}") == "Success") for i in range(expected)]
    return out.select(
        F.col("f0").alias("fork_id"), every(of(lambda s: s.isin(*OVER))).alias("ready"), every(succeeded).alias("all_succeeded"),
        some(of(lambda s: s == "Failed")).alias("any_failed"), some(of(lambda s: s == "FailedWithRecovery")).alias("any_recovered"),
    )
