"""Outcomes read off tables: approvals, answers or abstentions, coverage, what actions do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def approval_outcomes(requests: DataFrame, answers: DataFrame, levels: list[tuple[str, float]], now: Column) -> DataFrame:
    """What became of each approval request: request, level, outcome.

    ``requests``: request, asked_at. ``answers``: request, answered_at, approved. The first
    answer after the request counts, of several at one moment a refusal. ``levels``: names
    and seconds; a level that does not answer in its time hands on to the next. The level
    is the one in charge when the answer came, or now. Outcomes: approved, rejected,
    waiting, and expired (level null) once all levels have let their time pass.
    """
    asked = requests.select("request", "asked_at")
    first = answers.join(asked, "request").filter("answered_at >= asked_at").groupBy("request").agg(F.min(F.struct("answered_at", "approved")).alias("_a"))
    rows = asked.join(first, "request", "left")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    waited = micros(F.coalesce(F.col("_a.answered_at"), now)) - micros(F.col("asked_at"))
    level, total = F.lit(None).cast("string"), sum(s for _, s in levels)
    for name, seconds in reversed(levels):
        level = F.when(waited <= int(total * 1_000_000), name).otherwise(level)
        total -= seconds
    outcome = F.when(F.col("level").isNull(), "expired").when(F.col("_a.approved"), "approved").when(~F.col("_a.approved"), "rejected").otherwise("waiting")
    return rows.withColumn("level", level).select("request", "level", outcome.alias("outcome"))


def answer_or_abstain(questions: DataFrame, scored: DataFrame, least: float, nearest: int = 3, question_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """For each question the records that match it, or none and the nearest ones.

    ``scored``: question, document, score, rank, a list of bounded length for each
    question. Returns ``question_id``, outcome (answer or abstain), records (ids by rank:
    those with a score of ``least``, or the ``nearest``). A question without scored
    records abstains with an empty list.
    """
    item = F.struct("rank", F.col(doc_id).alias("doc"), (F.col("score") >= least).alias("hit"))
    rows = scored.groupBy(question_id).agg(F.array_sort(F.collect_list(item)).alias("_r"))
    matched = F.filter("_r", lambda r: r["hit"])
    some = F.coalesce(F.size(matched) > 0, F.lit(False))
    shown = F.transform(F.when(some, matched).otherwise(F.slice("_r", 1, nearest)), lambda r: r["doc"])
    none = F.array().cast(f"array<{scored.schema[doc_id].dataType.simpleString()}>")
    return questions.select(question_id).join(rows, question_id, "left").select(question_id, F.when(some, "answer").otherwise("abstain").alias("outcome"), F.coalesce(shown, none).alias("records"))


def coverage(subjects: DataFrame, covering: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Subjects whose key occurs in ``covering``, all, and those without, by group. A null key is not covered."""
    seen = covering.select(key).distinct().withColumn("_seen", F.lit(True))
    return subjects.join(seen, key, "left").groupBy(*by).agg(F.count("_seen").alias("covered"), F.count("*").alias("total"), (F.count("*") - F.count("_seen")).alias("uncovered"))


def effects(frames: dict[str, DataFrame], type_name: str, action: str) -> DataFrame:
    """What an action changes, creates and emits."""
    return frames["effects"].filter((F.col("type") == type_name) & (F.col("action") == action)).select("effect", "subject")


def resolved_actions(frames: dict[str, DataFrame], interface: str, action: str) -> DataFrame:
    """The implementors' own actions behind an interface's action; null where a type maps none."""
    types = frames["interfaces"].filter(F.col("interface") == interface).select("domain", "type")
    mine = frames["interface_actions"].filter((F.col("interface") == interface) & (F.col("interface_action") == action)).select("domain", "type", "action")
    return types.join(mine, ["domain", "type"], "left")
