"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, and DuckDB SQL with the same columns where SQL can express them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.checks: dict[str, tuple[Query, str]] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def model_check(self, sql: str) -> Callable[[Query], Query]:
        """A question about the model alone: it reads no table, so it is tested but is no query of the data."""

        def add(f: Query) -> Query:
            self.checks[f.__name__] = (f, sql)
            return f

        return add


#: Rows and bytes of an Arrow batch of texts; the row that passes the bytes ends a batch.
TEXT_ROWS, TEXT_BYTES = 512, 8 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts go to Python workers: sets the session's Arrow batches to ``TEXT_ROWS`` and ``TEXT_BYTES``.

    Texts are long, so that batches of 10,000 rows or 64 MB take hundreds of MB in each worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    return table(spark, sf_dir, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
