"""Detecting agents that go in circles, from the last entries of a progress ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity
from .ledger import recent

# Window, weights and thresholds, and what to do about each kind of loop.
WINDOW = 5
WEIGHTS = {"repetition": 0.4, "semantic": 0.3, "no_progress": 0.2, "frustration": 0.1}
RECOVERY, SIMILARITY, OSCILLATION = 0.7, 0.85, 0.8
STRATEGY = {"ExactRepetition": "InjectVariation", "NoProgress": "Decompose", "Oscillation": "Synthesize", "SemanticRepetition": "ForceRotation"}
FALLBACK = "Escalate"


def repetition(actions: Column) -> Column:
    """Share of the most frequent action."""
    most = F.array_max(F.transform(F.array_distinct(actions), lambda a: F.size(F.filter(actions, lambda x: x == a))))
    return F.coalesce(F.try_divide(most, F.size(actions)), F.lit(0.0)).cast("double")


def oscillation(actions: Column) -> Column:
    """The best share, over periods 2 to half the window, of actions that repeat the first period; 0 below 3 entries."""
    n = F.size(actions)

    def share(period: Column) -> Column:
        at = F.sequence(period, n - 1)
        same = F.filter(at, lambda i: F.get(actions, i) == F.get(actions, i % period))
        return F.try_divide(F.size(same), F.size(at))

    periods = F.when(n >= 4, F.sequence(F.lit(2), F.greatest(F.floor(n / 2).cast("int"), F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.transform(periods, share)), F.lit(0.0)).cast("double")


def word_similarity(outputs: Column) -> Column:
    """The highest Jaccard similarity of the words of two outputs; nulls and blanks aside."""
    sets = F.filter(F.transform(outputs, lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != ""))), lambda s: F.size(s) > 0)
    later = lambda s, i: F.array_max(F.transform(F.slice(sets, i + 2, F.size(sets)), lambda o: F.try_divide(F.size(F.array_intersect(s, o)), F.size(F.array_union(s, o)))))
    return F.coalesce(F.array_max(F.transform(sets, later)), F.lit(0.0)).cast("double")


def vector_similarity(vectors: Column) -> Column:
    """The highest cosine of two outputs' vectors, 0 at least; null and empty ones aside."""
    have = F.filter(vectors, lambda v: F.size(F.coalesce(v, F.array().cast("array<float>"))) > 0)
    later = lambda v, i: F.array_max(F.transform(F.slice(have, i + 2, F.size(have)), lambda o: cosine_similarity(v, o)))
    return F.coalesce(F.greatest(F.array_max(F.transform(have, later)), F.lit(0.0)), F.lit(0.0)).cast("double")


def verdicts(entries: DataFrame, key: str, order: list[str], action: str, progress: str, signal: str, output: Column | None = None, window: int = WINDOW, similar: Callable[[Column], Column] = word_similarity) -> DataFrame:
    """For each key: scores of its last ``window`` entries, loop type, confidence and strategy.

    ``similar`` measures the array of a window's outputs (of any type: texts, vectors) from 0 to 1.

    With fewer entries there is no loop and no confidence. The checks in order: all
    actions equal, no progress at all, oscillation, similar outputs, weighted sum. A
    confidence may exceed 1.
    """
    rows = recent(entries.withColumn("_out", F.lit(None).cast("string") if output is None else output), key, order, window)
    item = F.struct((-F.col("place")).alias("at"), F.col(action).alias("action"), F.col(progress).alias("progress"), F.col(signal).alias("signal"), F.col("_out").alias("output"))
    last = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_w"))
    part = lambda name: F.transform("_w", lambda e: e[name])
    share = lambda hit: F.size(F.filter("_w", hit)) / F.size("_w")
    s = last.select(
        key, F.size("_w").alias("entries"), repetition(part("action")).alias("repetition"), share(lambda e: ~e["progress"]).alias("no_progress"),
        oscillation(part("action")).alias("oscillation"), similar(part("output")).alias("semantic"), share(lambda e: F.coalesce(e["signal"].isin("HelpNeeded", "Failure"), F.lit(False))).alias("frustration"),
    )
    sums = F.lit(0.0)
    for name, w in WEIGHTS.items():
        sums = sums + F.col(name) * w
    s = s.withColumn("_sum", sums)
    top = F.greatest("repetition", "no_progress", "semantic")
    dominant = F.when(top == F.col("semantic"), "SemanticRepetition").when(top == F.col("no_progress"), "NoProgress").otherwise("ExactRepetition")
    kind = (
        F.when(F.col("entries") < window, None).when(F.col("repetition") >= 1, "ExactRepetition").when(F.col("no_progress") >= 1, "NoProgress").when(F.col("oscillation") >= OSCILLATION, "Oscillation")
        .when(F.col("semantic") >= SIMILARITY, "SemanticRepetition").when(F.col("_sum") >= RECOVERY, dominant)
    )
    s = s.withColumn("loop_type", kind)
    sure = (
        F.when(F.col("entries") < window, 0.0).when(F.col("repetition") >= 1, F.greatest(F.col("repetition") * WEIGHTS["repetition"], F.lit(RECOVERY))).when(F.col("no_progress") >= 1, F.greatest(F.col("no_progress") * WEIGHTS["no_progress"], F.lit(RECOVERY)))
        .when(F.col("oscillation") >= OSCILLATION, F.greatest(F.col("_sum") + F.col("oscillation") * 0.5, F.lit(RECOVERY))).when(F.col("semantic") >= SIMILARITY, F.greatest(F.col("_sum"), F.lit(RECOVERY))).otherwise(F.col("_sum"))
    )
    plan = F.create_map(*(F.lit(x) for kv in STRATEGY.items() for x in kv))
    strategy = F.when(F.col("loop_type").isNotNull(), F.coalesce(F.try_element_at(plan, F.col("loop_type")), F.lit(FALLBACK)))
    return s.withColumn("confidence", sure).withColumn("strategy", strategy).drop("_sum")
