"""Tables with a key on Parquet: upserts that are safe to repeat, to break off and to race."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: What happens to a row whose key the table holds: the new one counts, the old one does, or it is an error.
REPLACE, KEEP, FAIL = "replace", "keep", "fail"


class KeyConflict(ValueError):
    """A key of the new rows is in the table, and the rule forbids that."""


class Raced(RuntimeError):
    """Other writers came first, time after time."""


class KeyedTable:
    """One row a key. Rows lie in buckets by a hash of the key; a version names a folder for each bucket.

    A write puts the changed buckets into new folders and then makes the manifest of the
    next version, a file that can only be made once: it is there whole or not at all. What
    a broken write or a lost task left is named by no manifest and so never read. If
    another writer made that version, the write starts again from it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    # -- the manifest ------------------------------------------------------------

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last committed version; 0 for a table without any."""
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def manifest(self, version: int) -> dict:
        """Folders by bucket, and the batches that are in."""
        if version == 0:
            return {"buckets": {}, "batches": []}
        fs, p = self._fs(f"{self.path}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> bool:
        """Makes the manifest of ``version`` unless it exists.

        The text is written under a name of its own and renamed, so no reader sees half of
        it; the claim file decides between writers.
        """
        fs, final = self._fs(f"{self.path}/manifests/{version:012d}.json")
        _, claim = self._fs(f"{self.path}/claims/{version:012d}")
        _, draft = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            fs.create(claim, False).close()  # one writer alone can make a file
        except Py4JJavaError:
            fs.delete(draft, False)
            return False
        return bool(fs.rename(draft, final))

    # -- rows ----------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of an earlier one."""
        manifest = self.manifest(self.version() if version is None else version)
        folders = sorted(manifest["buckets"].values())
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def get(self, **key: object) -> DataFrame:
        """The row of one key, from its bucket alone."""
        values = [F.lit(key[k]).cast(self.schema[k].dataType) for k in self.keys]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")).head()[0]
        folder = self.manifest(self.version())["buckets"].get(str(bucket))
        rows = self.spark.read.schema(self.schema).parquet(folder) if folder else self.spark.createDataFrame([], self.schema)
        return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(self.keys, values, strict=True)]))

    def upsert(self, rows: DataFrame, order: list[str] | None = None, on_conflict: str = REPLACE, batch: str | None = None, attempts: int = 8) -> int:
        """Adds rows and returns the version that holds them.

        Of several new rows of one key the last by ``order`` (default: all columns) counts.
        ``batch`` names the write: a batch that is in already changes nothing, so a job may
        be run again after it broke off anywhere. Only the buckets that new keys fall into
        are read and written. Null keys are an error.
        """
        if on_conflict not in (REPLACE, KEEP, FAIL):
            raise ValueError(f"unknown rule {on_conflict}")
        new = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        if not new.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])).isEmpty():
            raise ValueError("a key is null")
        last = Window.partitionBy(*self.keys).orderBy(*(F.col(c).desc() for c in (order or self.schema.names)))
        stage = f"{self.path}/rows/{uuid.uuid4().hex}"
        new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").withColumn("_bucket", self._bucket()).write.parquet(f"{stage}/new")
        staged = self.spark.read.parquet(f"{stage}/new")
        touched = [r[0] for r in staged.select("_bucket").distinct().collect()]  # at most ``buckets``
        for attempt in range(attempts):
            base = self.version()
            manifest = self.manifest(base)
            if batch is not None and batch in manifest["batches"]:
                return base
            old = [manifest["buckets"][str(b)] for b in touched if str(b) in manifest["buckets"]]
            held = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
            fresh = staged.select(*self.schema.names)
            if on_conflict == FAIL and not held.join(fresh, self.keys, "left_semi").isEmpty():
                raise KeyConflict("a key is in the table already")
            if on_conflict == KEEP:
                merged = held.unionByName(fresh.join(held.select(*self.keys), self.keys, "left_anti"))
            else:
                merged = held.join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh)
            folder = f"{stage}/{attempt}"
            merged.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            buckets = {**manifest["buckets"], **{str(b): f"{folder}/_bucket={b}" for b in touched}}
            if self._commit(base + 1, {"buckets": buckets, "batches": [*manifest["batches"], *([batch] if batch is not None else [])]}):
                return base + 1
            self._wait_for(base + 1)
        raise Raced(f"{attempts} attempts met other writers")

    def _wait_for(self, version: int, seconds: float = 60.0) -> None:
        """Waits for the manifest of a version that another writer has claimed."""
        end = time.monotonic() + seconds
        while self.version() < version:
            if time.monotonic() > end:
                raise Raced(f"version {version} is claimed but not there; if its writer has died, release({version}) frees it")
            time.sleep(0.2)

    def release(self, version: int) -> None:
        """Frees a version whose writer died between claim and manifest. Only for a writer that is surely dead."""
        if self.version() < version:
            fs, claim = self._fs(f"{self.path}/claims/{version:012d}")
            fs.delete(claim, False)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes staged folders that none of the last versions names; returns how many. For quiet times."""
        last = self.version()
        named = {f for v in range(max(1, last - keep_versions + 1), last + 1) for f in self.manifest(v)["buckets"].values()}
        fs, p = self._fs(f"{self.path}/rows")
        gone = 0
        for stage in fs.listStatus(p) if fs.exists(p) else []:
            at = f"{self.path}/rows/{stage.getPath().getName()}"
            if not any(f.startswith(f"{at}/") for f in named):
                gone += bool(fs.delete(stage.getPath(), True))
        return gone
