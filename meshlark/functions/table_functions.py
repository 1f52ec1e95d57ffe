"""Table functions for SQL: chunks of a text, and steps between the rows of a partition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.chunking import CHUNKERS


@udtf
class ChunkText:
    """``chunk_text(text, method, tokens, overlap)``: chunk, content, start, end for each chunk of a text.

    ``method``, ``tokens`` and ``overlap`` are constants and checked when the query is
    analysed. Null and empty texts have no chunks.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, method: AnalyzeArgument, tokens: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("the first argument is a text")
        if not all(a.isConstantExpression for a in (method, tokens, overlap)):
            raise ValueError("method, tokens and overlap are constants")
        if method.value not in CHUNKERS:
            raise ValueError(f"unknown method {method.value}: {', '.join(sorted(CHUNKERS))}")
        if tokens.value < 1 or not 0 <= overlap.value < tokens.value:
            raise ValueError("tokens is at least 1, overlap is less")
        return AnalyzeResult(StructType([StructField("chunk", IntegerType()), StructField("content", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

    def eval(self, text: str, method: str, tokens: int, overlap: int) -> Iterator[tuple]:
        for i, (content, start, end) in enumerate(CHUNKERS[method](text or "", tokens, overlap)):
            yield i, content, start, end


@udtf
class Steps:
    """``steps(TABLE(log), key, step, time)``: each row of a key with the one before it: key, step_from, step_to, since, at.

    The names are constants; the function itself asks for the rows of a key together and in
    order of time, so the call needs no PARTITION BY. The first row of a key has no
    ``step_from``. It holds one row at a time.
    """

    @staticmethod
    def analyze(log: AnalyzeArgument, key: AnalyzeArgument, step: AnalyzeArgument, time: AnalyzeArgument) -> AnalyzeResult:
        if not log.isTable:
            raise ValueError("the first argument is a table")
        fields = {f.name: f.dataType for f in log.dataType}
        if missing := [a.value for a in (key, step, time) if a.value not in fields]:
            raise ValueError(f"no such columns: {', '.join(map(str, missing))}")
        if not isinstance(fields[time.value], TimestampNTZType):
            raise ValueError("times are timestamps without zone")
        moment = fields[time.value]
        out = [StructField("key", fields[key.value]), StructField("step_from", StringType()), StructField("step_to", StringType()), StructField("since", moment), StructField("at", moment)]
        return AnalyzeResult(StructType(out), partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(time.value), OrderingColumn(step.value)])

    def __init__(self):
        self.last = None

    def eval(self, row: Row, key: str, step: str, time: str) -> Iterator[tuple]:
        before = self.last or (None, None)
        self.last = (row[step], row[time])
        yield row[key], before[0], row[step], before[1], row[time]


def register(spark: SparkSession) -> None:
    """Makes ``chunk_text`` and ``steps`` known to the session's SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("steps", Steps)
