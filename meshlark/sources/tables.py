"""Sources and sinks: tables, event queries and artifacts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Folders of an event log.
LOG_PARTS = 64


def parquet_tables(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """``table(name)`` over a folder of ``<name>.parquet`` files; filters and columns reach the scan."""
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def checked(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the declared columns; an error if one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"columns do not fit the declaration: {', '.join(wrong)}")
    return df.select(*schema.names)


def store(df: DataFrame, path: str, schema: StructType | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Appends rows to a Parquet table, checked against the declared schema."""
    rows = df if schema is None else checked(df, schema)
    (rows.write.mode("append").partitionBy(*partition_by) if partition_by else rows.write.mode("append")).parquet(path)


def query_events(events: DataFrame, domain: str | None = None, object_type: str | None = None, object_id: str | None = None, since: datetime | None = None, kinds: list[str] | None = None, id_col: str = "object_id", kind_col: str = "event_type", time_col: str = "ts") -> DataFrame:
    """Events by domain, object type, object, time (at or after) and kinds; for tables and streams."""
    out = events
    for column, value in (("domain", domain), ("object_type", object_type)):
        if value is not None and column in events.columns:
            out = out.filter(F.col(column) == value)
    if object_id is not None:
        out = out.filter(F.col(id_col).cast("string") == object_id)
    if since is not None:
        out = out.filter(F.col(time_col) >= F.lit(since).cast(events.schema[time_col].dataType))
    return out if kinds is None else out.filter(F.col(kind_col).isin(*kinds))


def append_events(rows: DataFrame, path: str, key: str = "workflow_id") -> None:
    """Appends events to a log partitioned by a hash of their workflow, so that one workflow's are read without a scan of all."""
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(LOG_PARTS)).cast("int")).write.mode("append").partitionBy("part").parquet(path)


def read_events(spark: SparkSession, path: str, workflow: object, order: list[str], key: str = "workflow_id") -> DataFrame:
    """A workflow's events in order."""
    rows = spark.read.parquet(path)
    value = F.lit(workflow).cast(rows.schema[key].dataType)
    part = spark.range(1).select(F.pmod(F.xxhash64(value), F.lit(LOG_PARTS)).cast("int")).head()[0]
    return rows.filter((F.col("part") == part) & (F.col(key) == value)).drop("part").orderBy(*order)


class Artifacts:
    """Payloads as JSON in a Parquet table, by category and id; the newest version of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, category: str, id_col: str) -> None:
        """Stores each row as one artifact."""
        body = F.to_json(F.struct(*[c for c in rows.columns if c != id_col]))
        rows.select(F.lit(category).alias("category"), F.col(id_col).cast("string").alias("id"), body.alias("payload"), F.current_timestamp().alias("stored_at"), F.lit(False).alias("deleted")).write.mode("append").partitionBy("category").parquet(self.path)

    def delete(self, category: str, ids: list[str]) -> None:
        rows = self.spark.createDataFrame([(category, i, None) for i in ids], "category string, id string, payload string")
        rows.select("category", "id", "payload", F.current_timestamp().alias("stored_at"), F.lit(True).alias("deleted")).write.mode("append").partitionBy("category").parquet(self.path)

    def get(self, category: str) -> DataFrame:
        """id, payload of what was stored and not deleted since."""
        rows = self.spark.read.parquet(self.path).filter(F.col("category") == category)
        last = rows.groupBy("id").agg(F.max_by(F.struct("payload", "deleted"), "stored_at").alias("v"))
        return last.filter(~F.col("v.deleted")).select("id", F.col("v.payload").alias("payload"))
