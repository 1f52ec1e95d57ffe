"""Folders that the driver and all executors share, and cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a local master gets a
    temporary folder of this machine, and a cluster an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="meshlark-")
        sc.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new path under the shared folder; nothing is made there yet."""
    return f"{_base(spark).rstrip('/')}/meshlark-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    _base(df.sparkSession)
    return df.checkpoint()
