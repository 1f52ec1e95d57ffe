"""A data source of one's own: Parquet files through Arrow, with pushed filters, for batches and streams.

It shows what a source of another kind has to bring (schema, partitions, filters, offsets);
for plain Parquet, Spark's own reader is the faster choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_files"
_COMPARE = {S.EqualTo: lambda f, v: f == v, S.GreaterThan: lambda f, v: f > v, S.GreaterThanOrEqual: lambda f, v: f >= v, S.LessThan: lambda f, v: f < v, S.LessThanOrEqual: lambda f, v: f <= v}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[str]:
    """Data files below a path, or the file itself, in order of their names."""
    fs, at = _opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def _expression(f: S.Filter) -> ds.Expression | None:
    """A pushed filter for Arrow; None for those that it does not take."""
    if len(f.attribute) != 1:
        return None
    field = pc.field(f.attribute[0])
    if type(f) in _COMPARE:
        return _COMPARE[type(f)](field, f.value)
    if isinstance(f, S.In):
        return field.isin(list(f.value))
    return field.is_valid() if isinstance(f, S.IsNotNull) else None


@dataclass
class _Part(S.InputPartition):
    """Row groups of a file; None: all of them."""

    file: str
    groups: list[int] | None = None

    def __post_init__(self):
        super().__init__(self.file)


def _batches(path: str, part: _Part, schema: StructType, where: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    fs, _ = _opened(path)
    want = to_arrow_schema(schema)
    fragment = ds.ParquetFileFormat().make_fragment(part.file, fs, row_groups=part.groups)
    for batch in fragment.to_batches(columns=want.names, filter=where):
        if batch.num_rows:
            yield pa.Table.from_batches([batch]).cast(want).combine_chunks().to_batches()[0]


class _Reader(S.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.pushed = path, schema, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if (e := _expression(f)) is None:
                yield f
            else:
                self.pushed.append(e)

    def _where(self) -> ds.Expression | None:
        out = None
        for e in self.pushed:
            out = e if out is None else out & e
        return out

    def partitions(self) -> list[_Part]:
        """A task for each row group whose statistics leave room for the filters."""
        fs, _ = _opened(self.path)
        where = self._where()
        groups = [(f, g) for f in _files(self.path) for g in ds.ParquetFileFormat().make_fragment(f, fs).split_by_row_group(filter=where)]
        return [_Part(f, [r.id for r in g.row_groups]) for f, g in groups] or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from _batches(self.path, partition, self.schema, self._where())


class _StreamReader(S.DataSourceStreamReader):
    """Files in order of their names; the offset is how many have been read. Names of new files must sort last."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(f) for f in _files(self.path)[start["files"] : end["files"]]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition, self.schema, None)

    def commit(self, end: dict) -> None:
        pass


class ArrowFiles(S.DataSource):
    """``spark.read.format("arrow_files").load(path)``: a folder or file of Parquet, on any Arrow file system."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("give a path")
        return path

    def schema(self) -> StructType:
        files = _files(self._path())
        if not files:
            raise ValueError(f"no files in {self._path()}")
        return from_arrow_schema(ds.ParquetFileFormat().inspect(files[0], _opened(self._path())[0]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> S.DataSourceReader:
        return _Reader(self._path(), schema)

    def streamReader(self, schema: StructType) -> S.DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self._path(), schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, with filters pushed to it."""
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
