"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, decision_queries, ledger_queries, model_queries, object_queries, retrieval_queries, workflow_queries

_PARTS = (object_queries.C, retrieval_queries.C, ledger_queries.C, model_queries.C, workflow_queries.C, decision_queries.C, audit_queries.C)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of one nation's customers: three links and a filter after the last."""
    return object_queries.traverse_3hop(spark, sf_dir)


def queries() -> dict:
    return {k: f for c in _PARTS for k, f in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in _PARTS for k, s in c.sql.items()}


def model_checks() -> dict:
    """Questions about the model, which read no table: function and SQL by name."""
    return {k: x for c in _PARTS for k, x in c.checks.items()}
