"""Helpers shared by the operators of this subpackage.

Word and shingle hashing is done with numpy inside Arrow batches; Spark keeps the
partitioning, shuffles and joins.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a task's word-hash cache before it is emptied (about 25 MB).
WORD_CACHE = 120_000

_U = np.uint64


#: Rows of an Arrow batch. Texts are long: the default of 10,000 rows takes hundreds of MB
#: in the JVM's direct memory and again in the Python worker.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> SparkSession:
    """Sets the session's Arrow batches to ``BATCH_ROWS``; for applications that run these operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder path that the driver and all executors can reach.

    It lies under ``spark.checkpoint.dir``. Where that is missing, a local master gets a
    temporary folder of this machine, and a cluster an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="meshlark-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/meshlark-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``written`` that nothing will read any more."""
    for t in tables:
        if path := _folders.pop(t, None):
            _remove(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, every shared folder made inside: for jobs whose result is written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


#: A key with more than this share of the rows, and more rows than ``FEW``, is a hot one.
HOT_SHARE, FEW = 1 / 4096, 64


def look_up_spread(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``table`` has for a key, however many rows a key has.

    ``table`` tells in ``count`` how many of the ``total`` rows have the key. Keys with over
    ``FEW`` rows and over a 4,096th of all, hence at most 4,096 of them, are sent to the
    tasks and joined in place; the others meet by key. Both tables are read twice: give
    written ones, or such as cost little. Rows whose key ``table`` lacks go.
    """
    least = max(FEW, int(total * HOT_SHARE))
    hot = F.broadcast(table.filter(F.col(count) > least).drop(count))
    cool = table.filter(F.col(count) <= least).drop(count)
    cols = [*rows.columns, *(c for c in table.columns if c not in {*on, count})]
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).select(cols).unionByName(rest.join(cool.hint("merge"), on).select(cols))


#: Bytes of text in one range, and the most ranges that a corpus is cut into: beyond 3 TB ranges grow.
RANGE_BYTES, PARTS = 48 << 20, 1 << 16


class Ranges:
    """Ranges of rows in the order of two 64-bit keys: the first row of each, known to all tasks."""

    def __init__(self, heads: list[tuple[int, int]]):
        self.first = np.array([h[0] for h in heads], dtype=np.int64)
        self.second = np.array([h[1] for h in heads], dtype=np.int64)

    def __len__(self) -> int:
        return max(1, len(self.first))

    def at_most(self, most: int) -> Ranges:
        """As few neighbouring ranges joined as it takes to have at most ``most``."""
        step = max(1, -(-len(self.first) // most))
        out = Ranges([])
        out.first, out.second = self.first[::step], self.second[::step]
        return out

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each row's range."""
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        out = high - 1
        for i in np.flatnonzero((high - low > 1) | ((high > low) & (second < self.second[np.minimum(low, len(self.second) - 1)]))).tolist():
            out[i] = low[i] - 1 + np.searchsorted(self.second[low[i] : high[i]], second[i], "right")
        return np.maximum(out, 0)

    def heads(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which rows have the keys of the first row of their range."""
        if not len(self.first):
            return np.zeros(len(first), dtype=bool)
        at = self.of(first, second)
        return (self.first[at] == first) & (self.second[at] == second)


def byte_ranges(keys: DataFrame, range_bytes: int = RANGE_BYTES) -> Ranges:
    """Cuts rows, in the order of their keys, into ranges of about ``range_bytes``.

    ``keys``: two longs and the bytes of each row. The narrow rows are range-partitioned
    and sorted; each task adds up bytes and names the keys where a range begins, so what
    comes to the driver is 16 bytes a range. Rows with both keys equal stay together.
    """

    def cuts(batches):
        last, held = None, 0
        for b in batches:
            first, second, size = (b.column(i).to_numpy() for i in range(3))
            out = []
            for row in zip(first.tolist(), second.tolist(), size.tolist(), strict=True):
                if row[:2] != last:
                    if last is None or held >= range_bytes:
                        out.append(row[:2])
                        held = 0
                    last = row[:2]
                held += row[2]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["first", "second"])

    named = keys.toDF("first", "second", "size")
    found = named.repartitionByRange("first", "second").sortWithinPartitions("first", "second").mapInArrow(cuts, "first long, second long")
    return Ranges(sorted((r[0], r[1]) for r in found.toLocalIterator()))


_kept: dict = {}


def _give_back() -> None:
    """Returns memory that this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: object, make: Callable[[], object] | None = None):
    """What the tasks of one stage share in a worker process, made by the first of them.

    Workers serve stage after stage: what other stages left goes, so that their caches do
    not add up. Tasks that share nothing call it for that alone.
    """
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if _kept.get(None) != stage:
        _kept.clear()
        _kept[None] = stage
        _give_back()
    if make is None:
        return None
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


class WordCodes(dict):
    """Word (bytes) -> 64-bit hash. Emptied when full, so memory stays bounded. One a task."""

    def __init__(self):
        super().__init__()
        kept(None)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, no words none."""
    if not len(codes):
        return codes
    size = min(size, len(codes))
    acc = np.full(len(codes) - size + 1, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            acc = acc * _U(0x9E3779B97F4A7C15) + codes[j : len(codes) - size + 1 + j]
            acc ^= acc >> _U(29)
        return mix64(acc)


def shingle_set(text: bytes | None, size: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased, split at ASCII blanks)."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.unique(shingle_hashes(codes.of(text.lower().split()), size))


def utf8(column) -> list[bytes | None]:
    """A string column of an Arrow batch as bytes."""
    return column.cast(pa.binary()).to_pylist()


def filter_rows(docs: DataFrame, text_col: str, make_keep: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns as they are.

    ``make_keep`` is called once a task and returns a function from texts (bytes or None)
    to booleans. No shuffle, no join.
    """
    at = docs.columns.index(text_col)

    def task(batches):
        kept(None)
        keep = make_keep()
        for b in batches:
            yield b.filter(pa.array(np.asarray(keep(utf8(b.column(at))), dtype=bool)))

    return docs.mapInArrow(task, docs.schema)
